import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobsieve.llm import preference, quality, sharding


# ---- sharding ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [1, 200, 5000, 10**9])
def test_shards_fit_and_are_shortest_prefixes(spark, limit):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(60)) for i in range(300)] + [(None, None), (1, "é" * 400), (7, "")] + [(55, "hot key " * 6)] * 120
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id bigint, text string, shard string, depth int").repartition(4)
    got = sharding.assign_shards(docs, limit).collect()
    assert len(got) == len(rows)
    sizes, members = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.shard] += r.n_bytes
        members[r.shard] += 1
    for r in got:
        assert r.shard_bytes == sizes[r.shard] and r.shard_docs == members[r.shard] and len(r.shard) == r.depth
    assert all(b <= limit or members[s] == 1 for s, b in sizes.items())
    shards = set(sizes)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for s in shards:  # the parent bucket was too large
        if s:
            inside = [x for x in shards if x.startswith(s[:-1])]
            assert sum(sizes[x] for x in inside) > limit and sum(members[x] for x in inside) > 1


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.assign_shards(docs, 100).count() == 0


# ---- preference pairs ----------------------------------------------------------------------------------------

def test_longest_common_prefix_masks_and_edges(spark):
    schema = "pair_id bigint, turn int, role string, text string, prompt string"
    c = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "good", "x"), (2, 0, "user", "q", "x"), (2, 1, "assistant", "same", "x"), (3, 0, "user", "only chosen", "x"),
         (None, 0, "user", None, "x"), (5, 0, "user", "a", "x"), (5, 0, "user", "a", "x"), (5, 1, "assistant", "b", "x")]
    r = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "bád", "x"), (1, 2, "user", "why", "x"), (2, 0, "user", "q", "x"), (2, 1, "assistant", "same", "x"),
         (4, 0, "assistant", "only rejected", "x"), (None, 0, "user", None, "x"), (5, 0, "user", "a", "x"), (5, 1, "assistant", "b", "x")]
    got = {x.pair_id: x for x in preference.preference_pairs(spark.createDataFrame(c, schema), spark.createDataFrame(r, schema)).collect()}
    assert len(got) == 6
    assert (got[1].prompt_turns, got[1].prompt) == (1, "<|user|>\nhi\n")
    assert got[1].chosen == "<|assistant|>\ngood\n" and got[1].rejected == "<|assistant|>\nbád\n<|user|>\nwhy\n"
    for x in got.values():
        for side, mask in ((x.chosen, x.chosen_mask), (x.rejected, x.rejected_mask)):
            assert all("<|" not in side[s.start:s.end] for s in mask)
    assert [got[1].rejected[s.start:s.end] for s in got[1].rejected_mask] == ["bád"]
    assert got[2].prompt_turns == 2 and got[2].chosen == got[2].rejected == ""
    assert (got[3].prompt, got[3].rejected, got[4].chosen) == ("", "", "")
    assert got[None].prompt == "<|user|>\n\n" and got[5].prompt_turns == 1
    assert preference.preference_pairs(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def test_reply_swaps_differ_only_in_the_last_reply(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    chosen, rejected = preference.reply_swaps(conv)
    pairs = preference.preference_pairs(chosen, rejected).collect()
    assert pairs and all(p.chosen.startswith("<|assistant|>\n") or p.chosen == p.rejected == "" for p in pairs)
    assert any(p.chosen != p.rejected for p in pairs)


def test_reply_swaps_keep_null_turns_and_ids(spark):
    rows = [(2, None, "assistant", "a"), (2, 5, "user", "late"), (3, None, "user", "q"), (3, 1, "assistant", "b"),
            (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {p.pair_id: p for p in preference.preference_pairs(*preference.reply_swaps(conv)).collect()}
    assert set(got) == {2, 3, None}
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("", "<|assistant|>\na\n", "<|assistant|>\nb\n")
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == ("<|user|>\nq\n", "<|assistant|>\nb\n", "<|assistant|>\na\n")
    assert got[None].prompt == "<|user|>\nx\n<|assistant|>\ny\n" and got[None].chosen == got[None].rejected == ""


# ---- quality rules -------------------------------------------------------------------------------------------

def stats(text):
    import re
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i:i + 3])].append(i)
    covered = {i + j for places in seen.values() if len(places) > 1 for i in places for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_text_statistics_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "  \n\t", "a", "a b", "a b c a b c", "a b c d\na b c d\n a b c d\n\n", "x x x x x x", "é#ü *&| <b>", "\x0bq\x0cr\r\ns t u q r s t",
             *(" ".join(rng.choice("ab cd é# !".split()) for _ in range(rng.randrange(1, 200))) for _ in range(40)), "w " * 30_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_stats(docs).collect()}
    assert got == {i: stats(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.3), (50, 3, 0.2), (400, 1, 0.004), (100_000, 300, 0.004), (100_000, 399, 0.004), (2000, 0, 0.004), (5, 4, 0.9)])
def test_binomial_tail_is_exact(spark, n, k, p):
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p, 10_000).alias("v")).first().v
    assert got == pytest.approx(1.0 if k >= n * p else want, rel=1e-7)


def test_few_terms_only_err_on_the_safe_side(spark):
    cdf = lambda terms: spark.range(1).select(quality.binomial_cdf(F.lit(300).cast("long"), F.lit(100_000).cast("long"), 0.004, terms).alias("v")).first().v
    assert cdf(10_000) <= cdf(5) <= 2 * cdf(10_000)


def test_risk_is_kept_in_every_stratum_and_odd_rows_have_verdicts(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(4000):
        lang, good = ("aa", "bb")[i % 2], i % 5 != 0
        noise = 0.002 if good else 0.3
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" + ("***" if rng.random() < noise else "") for _ in range(60)), lang))
        labels.append((i, int(good)))
    rows += [(9001, None, "aa"), (9002, "", None), (9003, " ".join(f"v{j}" for j in range(70)), None), (9003, " ".join(f"v{j}" for j in range(70)), None), (None, "x " * 99, "aa")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id bigint, text string, lang string, kept boolean")
    table = spark.createDataFrame(labels + [(0, 0), (None, 1), (9001, None)], "doc_id bigint, quality int")
    got = quality.quality_verdicts(docs, table).collect()
    assert len(got) == len(rows)
    verdict = {r.doc_id: r for r in got}
    for s in (0, 1):
        good = [i for i, q in labels if q and i % 2 == s]
        assert sum(not verdict[i].kept for i in good) <= 0.03 * len(good)
    junk = [i for i, q in labels if not q]
    assert sum(verdict[i].kept for i in junk) < 0.1 * len(junk)
    assert verdict[9001].base_failed and verdict[9002].base_failed and verdict[9003].kept and not verdict[None].kept
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert all(r.kept == (not r.base_failed) for r in quality.quality_verdicts(docs, table.where("false")).collect())
    assert quality.quality_verdicts(docs.where("false"), table).count() == 0
