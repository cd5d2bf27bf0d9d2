import numpy as np

from chronoloom.llm import near_duplicates as nd


def test_common_words_with_rare_ones_and_repeats_meet(spark):
    """Pairs of eight common words and one rare word each (0.8 similar), and pairs of which one repeats its words tenfold."""
    rows, common = [], []
    for i in range(60):
        words = [f"c{i}x{k}" for k in range(8)]
        common += words
        rows += [("t", "f", f"a{i}{s}", " ".join([*words, f"rare{i}{s}"])) for s in "pq"]
        many = [f"m{i}x{k}" for k in range(9)]
        rows += [("t", "f", f"r{i}p", " ".join(many)), ("t", "f", f"r{i}q", " ".join([*many, f"more{i}"] * 10))]
    texts = spark.createDataFrame(rows, "table_name string, field string, id string, text string")
    members, classes = nd.classes_of(nd.word_rows(texts))
    hashes = spark.createDataFrame([(w,) for w in common], "w string").selectExpr("xxhash64(w) h").toPandas()["h"].to_numpy(np.int64)
    # the weight of a word in a third of very many texts
    weights = {"t.f": (np.sort(hashes), np.full(len(hashes), (np.log(3) / np.log(1000)) ** 2, np.float32))}
    cid = {r.id: r.cid for r in members.collect()}
    got = {(r.a, r.b) for r in nd.candidate_pairs(nd.bucket_rows(classes, weights), 0.8).collect()}
    pairs = [(cid[f"{k}{i}p"], cid[f"{k}{i}q"]) for k in "ar" for i in range(60)]
    met = [(min(p), max(p)) in got for p in pairs]
    assert sum(met) >= 119, (sum(met[:60]), sum(met[60:]))


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    """A bucket that most texts share is compared in blocks, whether it was foreseen by the sample or met on the way."""
    words = [f"t{i}" for i in range(30)]
    rows = [(f"x{i:03}", " ".join([*words, f"own{i}"])) for i in range(150)] + [("far", "a b c d e f g")]
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("'t' table_name", "'f' field", "id", "text")
    want = {(a, b) for i, (b, _) in enumerate(rows[:150]) for a, _ in rows[:i]}
    monkeypatch.setattr(nd, "BLOCK", 40)
    for look in (1.0, 0.01):
        monkeypatch.setattr(nd, "LOOK", look)
        assert {(r.id_a, r.id_b) for r in nd.near_duplicate_pairs(df).collect()} == want


def test_alignment_settles_what_it_can(spark):
    words = [f"w{i}" for i in range(40)]
    moved = words[20:] + words[:20]
    rows = [("a", " ".join(words)), ("b", " ".join([*words[:17], "new", *words[18:]])), ("c", " ".join([*moved, "end"]))]
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("'t' table_name", "'f' field", "id", "text")
    members, links = nd.near_duplicate_classes(df)
    of = {r.cid: r.id for r in members.collect()}
    assert {(*sorted((of[r.a], of[r.b])), r.settled) for r in links.collect()} == {("a", "b", "align"), ("a", "c", "words"), ("b", "c", "words")}
