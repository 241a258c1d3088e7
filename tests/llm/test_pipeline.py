"""The pipeline's stages on a small fixture: what each must drop or keep, and run() against the stages one by one."""

import random

import corpus_pipeline as cp
import pytest

from embertrail.llm import quality_classifier
from embertrail.llm.common import cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    passage = text(6)
    docs = [(i, text(8), "en", f"s{i % 3}") for i in range(120)]
    docs += [(200 + i, text(2) + "\n" + passage, "en", "s0") for i in range(4)]
    docs += [(300, docs[5][1].replace("\n", " ") + " " + word(), "en", "s1"), (301, docs[6][1], "en", "s2")]
    docs += [(400 + i, " ".join(word().upper() + "!!" for _ in range(80)), "en", "s1") for i in range(60)]
    d = str(tmp_path_factory.mktemp("docs"))
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, *_ in docs if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cut(stage(spark, docs, folder), "test")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == cp.COLUMNS, name
        assert docs.count() <= before.count() or name in ("mixing", "packing")
    ids = {n: {x.doc_id for x in d.select("doc_id").collect()} for n, d in seen.items()}
    assert not [i for i in ids["quality classifier"] if i >= 400] and set(range(120)) <= ids["quality classifier"]
    labels = spark.read.parquet(folder + "/labels.parquet")
    assert quality_classifier.classify(spark.read.parquet(folder + "/documents.parquet"), labels).where("kept").count() == len(ids["quality classifier"])
    texts = {x.doc_id: x.text for x in seen["line dedup"].collect()}
    assert 301 not in texts and set(range(120)) <= set(texts)
    assert [len(texts[200 + i].split("\n")) > 4 for i in range(4)] == [True, False, False, False]
    assert not {300, 301} & ids["MinHash near-dedup"] and set(range(120)) <= ids["MinHash near-dedup"]
    words = lambda d: sum(len(x.text.split()) for x in d.collect())
    assert abs(words(seen["mixing"]) - 1.5 * words(seen["MinHash near-dedup"])) <= 3
    assert all(x.n_chars == len(x.text) for x in seen["mixing"].collect())
    whole = seen["packing"].agg({"length": "sum"}).first()[0]
    again = cp.run(spark, folder)
    assert again.columns == seen["packing"].columns and again.agg({"length": "sum"}).first()[0] == whole


EDGE = "doc_id long, text string, lang string, source string, n_chars long, _id long, _size string, kept string, _lo string"


def test_edges_of_every_stage(spark, folder):
    """Nulls in every column, empty and long texts, ties and repeated rows, empty tables, extra columns of clashing names."""
    passage = "\n".join(f"this is line number {i} of a shared passage" for i in range(9))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, None, None, None, None), (None, passage, "en", "a", 5), (None, passage, "en", "a", 5), (3, passage, None, "b", 4),
        (4, passage + "\nand more", "en", None, 7), (5, "one two three four five six seven eight", "en", "b", 3), (5, "one two three four five six seven eight", "en", "b", 3),
        (5, "one two three four five six seven eight", "en", "b", 3), (6, "nine ten eleven twelve " * 30_000, "de", "a", 9), (7, "other text under seven", "en", "a", 1), (7, "and yet another text under seven", "en", "a", 1),
    ]
    docs = spark.createDataFrame([(*x, 1, "x", "y", "z") for x in rows], EDGE)
    ids = lambda d: sorted((x.doc_id or 0) for x in d.collect())
    kept = {}
    for name, stage in cp.STAGES:
        out = kept[name] = cut(stage(spark, docs, folder), "edge")
        if name != "packing":
            assert out.columns == cp.COLUMNS and all(x.n_chars == (None if x.text is None else len(x.text)) for x in out.collect())
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert ids(kept["line dedup"]) == [0, 0, 0, 1, 2, 3, 4, 5, 5, 5, 6, 7, 7] and {x.text for x in kept["line dedup"].collect() if x.doc_id == 4} == {"and more"}
    assert ids(kept["MinHash near-dedup"]) == [0, 0, 0, 1, 2, 3, 5, 6, 7]
    words = sum(len((x[1] or "").split()) for x in rows)
    assert abs(sum(len(x.text.split()) for x in kept["mixing"].collect()) - 1.5 * words) <= 4
    packed = kept["packing"].collect()
    assert len({(x.sequence_id, x.offset) for x in packed}) == len(packed) and sum(x.doc_id is None for x in packed) == 3


def test_repeated_rows_are_mixed_to_the_target(spark, folder):
    rows = [(1, "a b c d e f g", "en", "s", 1)] * 5 + [(2, " ".join("xyz"), "en", "t", 1), (3, " ".join(["w"] * 101), "en", "u", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = {"s": 35, "t": 3, "u": 101}
    got = {s: 0 for s in sizes}
    for x in cp.mixture(spark, docs, folder).collect():
        got[x.source] += len(x.text.split())
    from embertrail.llm import mixing

    want = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)


def test_one_row_of_a_group_stays_however_rows_repeat(spark, folder):
    text = " ".join(f"word{i}" for i in range(40))
    near = text + " end"
    rows = [(2, text), (2, text), (2, near), (1, near), (1, near), (5, "alone here with a few words of its own"), (5, "alone here with a few words of its own"), (6, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((x.doc_id, x.text or "") for x in cp.near_duplicates(spark, docs, folder).collect())
    assert got == [(1, near), (5, rows[5][1]), (6, ""), (6, "")]
