from pyspark.sql import functions as F

from jobsieve.functions.text import fold, quote_plus, tokens
from jobsieve.operators import ranking as rk
from jobsieve.operators import taxonomy as tx


def test_fold_and_tokens(spark):
    df = spark.createDataFrame([("Pflegefachkräfte für Übergröße & Straße!",)], "t string")
    r = df.select(fold("t").alias("f"), tokens("t").alias("k")).first()
    assert r["f"] == "pflegefachkraefte fuer uebergroesse strasse"
    assert r["k"] == sorted({"pflegefachkraefte", "fuer", "uebergroesse", "strasse"})


def test_concept_match_substring_and_tokens(spark):
    cs = tx.concept_set(spark, "occupation")
    df = spark.createDataFrame([("1", "Examinierte Pflegefachkraft (m/w/d)"), ("2", "nurse registered ward"), ("3", "")],
                               "id string, t string")
    m = {r["id"]: [c["preferred_label"] for c in r["m"]] for r in tx.match_concepts(df, F.col("t"), cs, "m").collect()}
    assert m["1"][0] == "Nurse"
    assert "Nurse" in m["2"]  # substring "nurse" and token subset {registered, nurse}
    assert m["3"] == []


def test_query_expansion_contains_aliases(spark):
    terms = rk.expanded_terms(spark, "Pflege")
    assert "nurse" in terms and "healthcare and nursing" in terms and "pflege" in terms


def _score_reasons(job, terms):
    # plain-Python oracle of the reference's per-term chain
    t = {k: str(job.get(k)).lower() for k in ("title", "role_type", "occupation_group", "company", "description")}
    skills = " ".join(job["required_skills"]).lower()
    esco = " ".join(job.get("search_terms", [])).lower()
    score, reasons = 0.0, []
    for term in terms:
        hits = [term in t["title"], term in t["role_type"] or term in t["occupation_group"], term in skills,
                term in esco, term in t["company"], term in t["description"]]
        ts = sum(p for h, p in zip(hits, [8, 5, 4, 3, 2, 1]) if h)
        if ts:
            score += ts
            for h, name in zip(hits, rk.REASONS):
                if h and name not in reasons:
                    reasons.append(name)
                    break
    return score, reasons


def test_score_and_reasons_match_python_oracle(make_postings):
    jobs = [dict(id="1", title="Senior Nurse", company="Charite", description="ward nurse", role_type="Healthcare",
                 occupation_group="Nursing", required_skills=["Patient Care"]),
            dict(id="2", title="Driver", company="Nurse Co", description="care", role_type=None, occupation_group=None,
                 required_skills=["care"])]
    df = make_postings(jobs).withColumn("search_terms", F.array().cast("array<string>"))
    terms = ["care", "nurse", "nursing"]
    got = {r["id"]: r for r in rk.score(df, terms, "").collect()}
    for j in jobs:
        s, reasons = _score_reasons(j, terms)
        assert got[j["id"]]["relevance_score"] == s
        assert list(got[j["id"]]["match_reasons"]) == reasons


def test_exact_title_boost_moves_title_match_first(make_postings):
    df = make_postings([dict(id="1", title="Nurse", description="nurse", required_skills=[])]) \
        .withColumn("search_terms", F.array().cast("array<string>"))
    r = rk.score(df, ["nurse"], "Nurse").first()
    assert r["relevance_score"] == 8 + 1 + 20 and r["match_reasons"][0] == "title match"


def test_quote_plus_matches_python(spark):
    from urllib.parse import quote_plus as qp
    s = "Pflege & Care ~*/,ü"
    got = spark.range(1).select(quote_plus(F.lit(s)).alias("u")).first()["u"]
    assert got == qp(s)


def test_suggestions_first_category_wins(make_postings):
    df = make_postings([dict(id="1", title="Nurse", company="Nurse GmbH", location="Berlin", role_type="nurse",
                             required_skills=["Nurse"])])
    out = rk.suggestions(df, "nurse", limit=8).collect()
    values = [r["value"].lower() for r in out]
    assert len(values) == len(set(values))
    assert out[0]["category"] == "title" and out[0]["value"] == "Nurse"


def test_rarest_gram_join_equals_row_local_path(spark):
    import random
    words = ["nurse", "pflege", "care", "worker", "cad", "cadet", "sales", "assistant", "excel", "qa", "engineer",
             "xyz", "lagerarbeit", "koch", "customer", "support", "iso", "9001", "ä", "ü"]
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in range(300)] + [(999, None), (998, "nurse"), (997, "nurse")]
    df = spark.createDataFrame(rows, "id long, t string")
    joined = sorted(tuple(r) for r in tx.match_concepts_join(df, "id", F.col("t"), tx.load_concepts(spark)).collect())
    local = sorted((r["id"], c["ordinal"]) for r in tx.match_concepts(df, F.col("t"), tx.concept_set(spark), "m").collect() for c in r["m"])
    assert joined == local and len(joined) > 100


def test_cut_lineage_knows_the_size_of_what_it_wrote(spark):
    from jobsieve.session import cut_lineage
    few = spark.range(4).select(F.explode(F.sequence(F.lit(1), F.lit(50000))).alias("n"))
    cut = cut_lineage(few.select(F.md5(F.col("n").cast("string")).alias("v"), F.lit(None).cast("string").alias("none")))
    size = int(str(cut._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > 1_000_000 and cut.count() == 200_000 and cut.columns == ["v", "none"]
    assert cut_lineage(spark.range(2).select("id", F.lit(None).alias("void"))).count() == 2  # what Parquet cannot hold


def test_texts_are_never_broadcast(spark):
    df = spark.createDataFrame([(1, "a nurse and a bookkeeper"), (2, ""), (3, None), (4, "A Nurse and a bookkeeper")], "id int, t string")
    c = spark.createDataFrame([(0, ["nurse", "x"]), (1, ["keeper nurse"]), (2, ["keep"]), (3, ["nurse bookkeeper", "and"]), (4, ["a"]), (5, ["b9"])], "ordinal int, all_terms array<string>")
    m = tx.match_concepts_join(df, "id", F.col("t"), c)
    assert {tuple(r) for r in m.collect()} == {(i, o) for i in (1, 4) for o in (0, 2, 3, 4)}
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_k" in plan and "BroadcastHashJoin [_k" not in plan


def test_batch_matcher_equals_brute_force(spark):
    import random
    c = spark.createDataFrame([(0, "skill", ["customer service"]), (1, "skill", ["cad"]), (2, "skill", ["hr manager", "qa"]), (3, "skill", ["a"]), (4, "skill", ["iso 9001", "--"])],
                              "ordinal int, concept_type string, all_terms array<string>").withColumns(
        {"preferred_label": F.get("all_terms", F.lit(0)), "concept_uri": F.lit(None).cast("string"), "broader_group": F.lit("g"), "aliases": F.slice("all_terms", 2, 9)})
    cs = tx.ConceptSet(spark, concepts=c)
    rnd, words = random.Random(3), ["service", "customer", "cadet", "manager", "managers", "hr", "qa", "9001", "iso", "b", "a", "", "xx"]
    lists = [None, [], [None], [""]] + [[" ".join(rnd.choices(words, k=rnd.randint(0, 5))) for _ in range(rnd.randint(0, 4))] for _ in range(300)]

    def match(text):
        nt = " ".join((text or "").split())
        return [i for i, terms in cs.entries if any(n and (n in nt or (t and set(t) <= set(nt.split()))) for n, t in terms)]

    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "id int, required_skills array<string>").withColumns({x: F.lit(None).cast("string") for x in ("title", "role_type", "occupation_group", "description")})
    e = tx.enrich_postings(df, cs, cs)
    got = {r["id"]: [x["ordinal"] for x in r["skill_concepts"]] for r in e.collect()}
    assert got == {i: list(dict.fromkeys(o for t in v or [] for o in match(t))) for i, v in enumerate(lists)}
    whole = df.select("id", F.array_join(F.coalesce("required_skills", F.array().cast("array<string>")), " ").alias("t"))
    m = tx.match_concepts(whole, F.col("t"), cs, "m")
    assert {r["id"]: [x["ordinal"] for x in r["m"]] for r in m.collect()} == {i: match(" ".join(t for t in v or [] if t)) for i, v in enumerate(lists)}
    # a row is not tested term by term in the plan
    assert "contains(" not in e._jdf.queryExecution().executedPlan().toString().lower()


def test_facets_and_stored_results_are_not_sorted(make_postings, monkeypatch):
    from jobsieve.operators import search as se
    from jobsieve.plans import ranking_plans as rp
    df = make_postings([dict(id=str(i), title=f"small ring {i % 7}", company=f"c{i % 6}", location="Berlin", role_type=None if i % 2 else "r", salary_min=1.0 + i, salary_max=9.0 + i) for i in range(40)])
    df = df.withColumns({"salary_period": F.lit("yearly"), "company_career_url": F.lit(None).cast("string"), "last_seen_at": F.lit(None).cast("timestamp_ntz")})
    facets = se.result_top_facets(se.order_results(df.withColumns({"relevance_score": F.lit(1.0), "salary_midpoint": F.lit(1.0)})))
    assert "rangepartitioning" not in facets._jdf.queryExecution().executedPlan().toString()
    got = {(r.facet, r.value): (r["count"], r["rank"]) for r in facets.collect()}
    assert got[("role_types", "r")] == (20, 1) and got[("top_companies", "c0")] == (7, 1) and got[("top_locations", "Berlin")] == (40, 1) and ("top_companies", "c5") not in got
    plans = []
    keep = rp.cut_lineage
    monkeypatch.setattr(rp, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d))
    monkeypatch.setattr(rp, "postings", lambda *_: df)
    rows = rp.w6_sort_modes(df.sparkSession, "").collect()
    assert "rangepartitioning" not in plans[0] and len(rows) == 80 and {r.place for r in rows} == {*range(11, 21)}
