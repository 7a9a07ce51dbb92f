"""Steps whose work or memory once grew faster than their input."""

from pyspark.sql import functions as F

from tallyforge.functions.text import normalized, r4, similarity
from tallyforge.operators import dedupe, match
from tallyforge.sources import delimited


def _numbered(spark, n):
    return spark.range(n).select(F.format_string("supplier %09d", F.col("id") * 7919 % 100_000).alias("form"))


def _broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_forms_one_edit_apart(spark):
    """As many pairs as brute force finds within an edit, and none sent out by the driver."""
    forms = _numbered(spark, 400)
    names = forms.select(F.concat("form", F.lit("0")).alias("name"))
    pairs = match.one_edit_apart(names, forms)
    assert _broadcasts(pairs) == 0
    near = names.crossJoin(forms).where(F.levenshtein("name", "form") <= 1)
    assert near.count() > 300 and near.join(pairs, ["name", "form"], "left_anti").isEmpty()
    assert pairs.count() < 2 * near.count()


def test_matching_sends_no_names_out_by_the_driver(spark):
    known = _numbered(spark, 300).select(F.col("form").alias("owner"), "form", F.lit(0).alias("alias"))
    names = known.select(F.concat("form", F.lit("0")).alias("name"))
    assert _broadcasts(match.near_scores(names, known, match.MARKET)) == 0
    model = match.nearest_by_model(names.withColumn("owner", F.expr("substring(name, 1, 18)")), known)
    assert _broadcasts(model) == 0
    plain = match.tfidf_best(names, known.select(F.col("form").alias("name")))
    assert sorted(map(tuple, model.select("name", "owner", "cosine").collect())) == sorted(map(tuple, plain.collect()))


def test_name_neighbours_compare_few_pairs(spark):
    """Every pair that brute force finds, without comparing all names that share a word."""
    long = "a very long name of a market that stands beside the old road to the northern lake"
    odd = ["hot bolt", "Hot  bolt", "bolt hot", "hot bolt x", "x hot bolt", "hot bolts", "", "??", "a b c d", "a b c e", "a b c", "supplier 000000000 0", long, f"{long} x", f"{long} side", "solo", "solos"]
    names = _numbered(spark, 300).select(F.col("form").alias("name")).union(spark.createDataFrame([(x,) for x in odd], "name string"))
    x = names.distinct().withColumn("form", normalized(F.col("name"))).where("form <> ''")
    both = x.select(F.col("name").alias("a"), F.col("form").alias("f")).crossJoin(x.select(F.col("name").alias("b"), F.col("form").alias("g")))
    shared = F.arrays_overlap(F.split("f", " "), F.split("g", " "))
    want = both.where(shared).withColumn("score", r4(similarity(F.col("f"), F.col("g")))).where(F.col("score") >= dedupe.NEAR).select("a", "b", "score")
    got = dedupe.name_neighbours(names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lines_are_sorted_in_chunks(spark, tmp_path, monkeypatch):
    """Records that cross chunks are put together, and no window is over more lines than a chunk."""
    monkeypatch.setattr(delimited, "CHUNK", 4)
    cells = [f'{k},"a{k}\nb\nc",x' if k % 3 == 0 else f"{k},a{k},x" for k in range(40)]
    (tmp_path / "t.csv").write_text("\n".join(["id,note,last", *cells]) + "\n")
    lines = delimited.lines_of(spark, str(tmp_path))
    assert lines.groupBy("file", "block", "chunk").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] == 4
    assert [r.text for r in delimited.records_of(lines).orderBy("line").collect()] == ["id,note,last", *cells]
    rows = delimited.read(spark, str(tmp_path), ",", ["id", "note", "last"], ["id", "note", "last"]).rows.collect()
    assert [(int(r.id), r.last) for r in rows] == [(k, "x") for k in range(40)]
