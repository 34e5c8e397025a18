"""DuckDB SQL text for the taxonomy and text twins used by oracle queries."""

from __future__ import annotations

import csv
import io

from jobsieve.sources.taxonomy_seed import SEED_CSV


def q(v):
    return "NULL" if v is None or v == "" else "'" + str(v).replace("'", "''") + "'"


def fold(x: str) -> str:
    v = f"lower(coalesce(CAST({x} AS VARCHAR), ''))"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        v = f"replace({v}, '{a}', '{b}')"
    return f"trim(regexp_replace({v}, '[^a-z0-9]+', ' ', 'g'))"


def folded_tokens(nt: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({nt}, ' '), lambda t: length(t) >= 3)))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _concepts():
    out = []
    for i, r in enumerate(csv.DictReader(io.StringIO(SEED_CSV))):
        aliases = [a.strip() for a in (r["aliases"] or "").split(";") if a.strip()]
        out.append((i, r["concept_type"].strip(), r["preferred_label"].strip(), (r["broader_group"] or "").strip(),
                    [r["preferred_label"].strip()] + aliases))
    return out


def taxonomy_ctes() -> str:
    """CTEs ``_concepts(ordinal, concept_type, preferred_label, broader_group, all_terms)`` and
    ``_tn(ordinal, concept_type, preferred_label, tnorm, ttok)``."""
    rows = []
    terms = []
    for o, t, label, broader, all_terms in _concepts():
        lst = "[" + ", ".join(q(a) for a in all_terms) + "]"
        rows.append(f"({o}, {q(t)}, {q(label)}, {q(broader)}, {lst})")
        for pos, a in enumerate(all_terms):
            terms.append(f"({o}, {pos}, {q(a)})")
    return (
        "_concepts AS (SELECT * FROM (VALUES " + ", ".join(rows) +
        ") v(ordinal, concept_type, preferred_label, broader_group, all_terms)),\n"
        "_terms AS (SELECT * FROM (VALUES " + ", ".join(terms) + ") v(ordinal, term_pos, term)),\n"
        f"_tn AS (SELECT c.ordinal, c.concept_type, c.preferred_label, {fold('t.term')} AS tnorm, "
        f"{folded_tokens(fold('t.term'))} AS ttok FROM _terms t JOIN _concepts c USING (ordinal))"
    )


def hit(nt: str, tt: str, t: str = "_tn") -> str:
    return (f"({nt} <> '' AND {t}.tnorm <> '' AND (contains({nt}, {t}.tnorm) OR "
            f"(len({t}.ttok) > 0 AND list_has_all({tt}, {t}.ttok))))")
