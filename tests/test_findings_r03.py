"""Cases behind the findings of the third review."""

from pyspark.sql import functions as F

from quillspark.operators import evidence, extraction


def shuffled(spark, df):
    """Rows that the stages of a run wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    before = stages().size()
    df().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    after = stages()
    return sum(after.apply(i).shuffleWriteRecords() for i in range(after.size() - before))


def test_digits_of_a_phone_number_are_no_year(spark):
    rows = [(1, 0, "Title of a paper +1 (235) 555-2058 un."), (1, 1, "Received 1987."), (2, 0, "call +1 (705) 555-1902 at once"), (3, 0, "+49 30 555 2051 10.5555/ab3c 1999")]
    found = extraction.source_metadata(spark.createDataFrame(rows, "paper_id long, idx int, text string"), "paper_id").collect()
    assert {r.paper_id: (r.doi, r.year) for r in found} == {1: (None, 1987), 2: (None, None), 3: ("10.5555/ab3c", 1999)}


def test_author_year_meets_each_name_once(spark):
    mentions = spark.range(400).select(F.col("id").alias("mention_id"), (F.col("id") % 2).alias("paper_id"), F.lit(1999).alias("year"), F.when(F.col("id") == 7, "b").otherwise("a").alias("token"))
    refs = spark.range(400).select((F.col("id") % 2).alias("paper_id"), F.col("id").alias("ref_num"), F.lit(1999).alias("year"), F.lit("a").alias("surname"))
    one = spark.createDataFrame([(1, 9, 1999, "b"), (1, 9, 1999, "b")], "paper_id long, ref_num long, year int, surname string")
    both = refs.unionByName(one)
    assert [(r.mention_id, r.ref_num) for r in evidence.author_year(mentions, both).collect()] == [(7, 9)]
    plan = evidence.author_year(mentions, both)._jdf.queryExecution().optimizedPlan().toString()
    # references of one name are one row before the mentions meet them
    assert plan.index("Join") < plan.rindex("Aggregate [paper_id")


def test_pairs_sharing_tokens_are_not_shuffled_token_by_token(spark, monkeypatch):
    import itertools
    import random

    from quillspark.operators import aggregates, relational

    r = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    rows = [(i, r.choice("gh") if i else None, r.sample(words, r.randrange(7)), r.choice([-1, 0, 1])) for i in range(120)] + [(1000 + i, "g", words[:6], 1 if i % 3 else -1) for i in range(230)]
    claims = spark.createDataFrame(rows, "claim_id long, grp string, tokens array<string>, p int").repartition(4)
    want = {(g, a, b): len({*s} & {*t}) for (a, g, s, _), (b, h, t, _) in itertools.combinations(rows, 2) if g == h and g and len({*s} & {*t}) >= 3}
    sign = {i: p for i, _, _, p in rows}
    both = [(a, b) for _, a, b in want if sign[a] and sign[b]]
    for block in (8192, 16):
        monkeypatch.setattr(relational, "BLOCK", block)
        found = relational.pairs_in_group(claims, ["grp"], 3, F.col("tokens"))
        got = found.collect()
        assert len(got) == len(want) and {(x.grp, x.a, x.b): x.shared for x in got} == want
        stats = aggregates.token_conflicts(claims, ["grp"], 3, F.col("tokens"), F.col("p")).first()
        assert (stats.comparable, stats.conflicts) == (len(both), sum(sign[a] != sign[b] for a, b in both))
    monkeypatch.setattr(relational, "BLOCK", 8192)
    # each of the pairs was a row of a shuffle before, so was each of the tokens that a pair shares in every task
    assert shuffled(spark, lambda: relational.pairs_in_group(claims, ["grp"], 3, F.col("tokens"))) < len(want) / 4


def test_evidence_shuffles_units_and_texts_once(spark):
    from quillspark.operators import lexical_index

    words = " ".join(f"word{i}" for i in range(30))
    rows = spark.range(40).select((F.col("id") % 2).alias("by"), F.col("id").alias("chunk_id"), F.col("id").cast("int").alias("pos"), F.lit(words).alias("text"))
    units = rows.select("by", F.concat(F.lit("u"), "chunk_id").alias("unit_id"), F.col("text").alias("query")).unionByName(spark.createDataFrame([(None, "none", "word1")], "by long, unit_id string, query string"))
    found = {x.unit_id: (x.chunk_ids, x.weak) for x in lexical_index.lexical_evidence(units, rows, "by").collect()}
    assert found["none"] == ([], True) and found["u6"] == ([0, 2], False) and found["u7"] == ([1, 3], False) and len(found) == 41
    # neither grams of words nor pairs of units and chunks
    assert shuffled(spark, lambda: lexical_index.lexical_evidence(units, rows, "by")) <= 81


def test_steps_that_share_entities_meet_in_blocks(spark, monkeypatch):
    import random

    from quillspark import registry
    from quillspark.operators import relational

    assert "l_partkey % 97" in registry.ORACLES["shared_entity_edges"]
    r = random.Random(5)
    rows = [(e, s, s % 3, r.random()) for s in range(60) for e in r.sample(range(12), 6)]
    own = {}
    for e, s, _, x in rows:
        own.setdefault(s, {})[e] = x
    want = {}
    for a in own:
        for b in own:
            both = own[a].keys() & own[b].keys()
            if a < b and a % 3 != b % 3 and both:
                want[(a, b)] = round(sum(own[a][e] + own[b][e] for e in both) / len(both) / 2 + 0.05 * len(both), 6)
    explains = spark.createDataFrame(rows, "entity_id long, step_id long, paper_id long, score double").repartition(4)
    for block in (2048, 16):
        monkeypatch.setattr(relational, "STEP_BLOCK", block)
        assert {(x.a, x.b): round(x.score, 6) for x in relational.shared_entity_edges(explains).collect()} == want
    monkeypatch.setattr(relational, "STEP_BLOCK", 2048)
    assert shuffled(spark, lambda: relational.shared_entity_edges(explains)) < len(want)


def test_levels_are_not_broadcast_in_each_round(spark, monkeypatch):
    from quillspark.operators import graph

    plans, keep = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    edges = spark.range(300).where("id % 4 != 3").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    levels = graph.topological_levels(edges, spark.range(300).select(F.col("id").alias("node")))
    assert {(r.node, r.level) for r in levels.collect()} == {(i, i % 4) for i in range(300)}
    rounds = [p for p in plans if "Join" in p]
    assert rounds and all(p.count("strategy=merge") == p.count("Join ") == 2 for p in rounds)


def test_pairs_of_parts_are_made_in_many_tasks(spark):
    from quillspark import registry

    plan = registry.QUERIES["merge_triggers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [p_brand") == 2
