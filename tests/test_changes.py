"""Changes applied to tables, snapshots, files and providers."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import durable
from claimloom.operators import merging, providers, search
from claimloom.sources import files, snapshots


def test_changes_apply_once_and_last_holds(spark):
    base = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("3", None, 3)], "k string, v string, keep int")
    log = spark.createDataFrame([("x", "1", 5, "n1"), ("x", "1", 5, "n1"), ("y", "1", 7, "n2"), ("z", "1", 6, "n3"), ("w", "3", 1, None), ("q", "9", 1, "new"), (None, "2", 9, "no id"), ("r", None, 9, "no key")], "id string, k string, at int, v string")
    last = merging.latest_change(log, "k", "id", ["at"], ["v"])
    assert {(r.k, r.n_changes, r.v) for r in last.collect()} == {("1", 3, "n2"), ("3", 1, None), ("9", 1, "new")}
    once = merging.upsert(base, last, "k", ["v"])
    assert {tuple(r) for r in once.collect()} == {("1", "n2", 1), ("2", "b", 2), ("3", None, 3)}
    assert {tuple(r) for r in merging.upsert(once, last, "k", ["v"]).collect()} == {tuple(r) for r in once.collect()}
    assert ("9", "new", None) in {tuple(r) for r in merging.upsert(base, last, "k", ["v"], add=True).collect()}
    assert merging.upsert(base.limit(0), last, "k", ["v"]).count() == 0


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "k string, v string")
    root = f"file://{tmp_path}/s"
    first = snapshots.write({"t": df}, root)
    second = snapshots.write({"t": df.limit(1), "u": df}, root)
    assert snapshots.versions(spark, root) == sorted([first, second]) and snapshots.current(spark, root) == (second, ["t", "u"])
    assert {(r.table_name, r.problem) for r in snapshots.check(spark, root).collect()} == {("t", None), ("u", None)}
    assert snapshots.read(spark, root, first)["t"].count() == 2
    spark.createDataFrame([("1", "a"), ("2", "tampered")], "k string, v string").write.mode("overwrite").parquet(f"{root}/{second}/u")
    assert {(r.table_name, r.problem) for r in snapshots.check(spark, root).collect()} == {("t", None), ("u", "content")}


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    df = spark.createDataFrame([("1", "a")], "k string, v string")
    root = f"file://{tmp_path}/s"
    first = snapshots.write({"t": df}, root)
    broken = df.select(F.raise_error(F.lit("broken")).cast("string").alias("k"))
    with pytest.raises(Exception, match="broken"):
        snapshots.write({"t": df, "u": broken}, root)
    assert snapshots.current(spark, root) == (first, ["t"])
    (tmp_path / "s" / "current-000000000002.json").write_text("")  # another writer took the number
    third = snapshots.write({"t": df}, root)
    assert snapshots.current(spark, root) == (third, ["t"])


def test_temporary_files_go(spark):
    before = durable.written(spark.range(3), "gone")
    assert before.count() == 3 and durable.release(spark) > 0 and durable.release(spark) == 0
    assert durable.written(spark.range(3), "there").count() == 3


def test_file_rules(spark, tmp_path):
    for name, content in {"good.pdf": b"%PDF-1.4\n" + b"x" * 5000 + b"\n%%EOF\n", "cut.pdf": b"%PDF-1.4\n" + b"%%EOF" + b"x" * 5000, "text.pdf": b"hello", "large.pdf": b"%PDF-" + b"x" * 9000, "empty.pdf": b""}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.problem for r in files.file_rules(spark, f"file://{tmp_path}/*.pdf", largest=8000).collect()}
    assert got == {"good.pdf": None, "cut.pdf": "cut off", "text.pdf": "not of the kind", "large.pdf": "too large", "empty.pdf": "empty"}


def test_annotations_and_layouts(spark, tmp_path):
    rows = [{"annotation_id": "1", "source_quote": "q\n"}, {"annotation_id": "2"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    for f in ("a.json", "a.jsonl"):
        got = files.annotations(spark, f"{tmp_path}/{f}", "annotation_id string, source_quote string").where("annotation_id IS NOT NULL")
        assert {tuple(r) for r in got.collect()} == {("1", "q\n"), ("2", None)}
    spark.createDataFrame([("1", 2)], "a string, b int").write.parquet(f"{tmp_path}/x")
    spark.createDataFrame([("3",)], "old string").write.parquet(f"{tmp_path}/y")
    got = files.layouts(spark, {"new": f"{tmp_path}/x", "old": f"{tmp_path}/y"}, {"old": {"old": "a"}})
    assert {(r.a, r.b, r.layout) for r in got.collect()} == {("1", 2, "new"), ("3", None, "old")}


def test_providers(spark):
    df = spark.createDataFrame([("1", "the quick brown foxes jumped"), ("2", "nothing"), ("3", None)], "id string, text string")
    known = [{"source_quote": "Quick brown foxes jumped over"}]
    got = {r.id: (r.answer, r.error) for r in providers.answers(df, "text", providers.fixed(known, 0.7)).collect()}
    assert json.loads(got["1"][0])["claims"] == known and json.loads(got["2"][0])["claims"] == [] and got["3"] == (None, None)

    def failing():
        tries = []

        def answer(texts):
            tries.append(1)
            if len(tries) < 3:
                raise OSError("not yet")
            return [t.upper() for t in texts]

        return answer

    assert {r.answer for r in providers.answers(df.where("id = '2'"), "text", failing, wait=0).collect()} == {"NOTHING"}
    bad = providers.answers(df.where("id = '2'"), "text", failing, attempts=2, wait=0).first()
    assert bad.answer is None and bad.error == "OSError: not yet"
    assert df.limit(1).select(providers.prompt("{a}-{b}", a=df.id, b=df.text)).first()[0] == "1-the quick brown foxes jumped"


def test_reindexing_twice_changes_nothing(spark):
    ix = lambda rows: search.indexed(spark.createDataFrame(rows, "id string, t string"), "id", ["t"])
    posts = search.postings(ix([("1", "a b"), ("2", "a")]))
    changed = ix([("2", "c c"), ("3", "a")])
    once = search.reindexed(posts, changed)
    assert {tuple(r) for r in once.collect()} == {("a", "1", 1), ("b", "1", 1), ("c", "2", 2), ("a", "3", 1)}
    assert {tuple(r) for r in search.reindexed(once, changed).collect()} == {tuple(r) for r in once.collect()}
