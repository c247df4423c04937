"""The corpus pipeline on small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import brute_classes, brute_kept, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long, size int, score double")
    rows.withColumns({"n_removed": F.lit(1), "kept_text": F.lit("x"), "class_id": F.lit(2), "row": F.lit(3)}).repartition(3).write.parquet(f"{path}/documents.parquet")
    rows.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/none/documents.parquet")
    return path


def test_stages_keep_columns_and_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        rows = docs.collect()
        sizes[name] = len(rows)
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    ids = {r.doc_id for r in docs.collect()}
    assert ids.isdisjoint(range(25, 30))  # exact copies
    assert ids.isdisjoint(range(30, 35))  # near copies
    assert set(range(25)) <= ids  # clean documents
    assert sizes["language_id"] > sizes["minhash"]


def rows_of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def brute_line_stage(rows, least=2, long=50):
    """(doc_id, text) -> what stays of the text; None if its lines have all gone."""
    runs, lines, out = set(), set(), {}
    for i, text in sorted({(r.doc_id, r.text) for r in rows}, key=lambda x: (x[0], str(x[1]))):
        every = (text or "").split("\n")
        content = [(j, x.strip()) for j, x in enumerate(every) if x.strip()]
        gone = set()
        for n, (_, line) in enumerate(content):
            run = tuple(x for _, x in content[n : n + least])
            if len(run) == least:
                gone |= set(range(n, n + least)) if run in runs else set()
                runs.add(run)
            if len(line.split()) >= long:
                gone |= {n} if line in lines else set()
                lines.add(line)
        places = {content[n][0] for n in gone}
        kept = text if not gone else "\n".join(x for j, x in enumerate(every) if j not in places)
        out[i, text] = None if gone and not kept.strip() else (kept, bool(gone))
    return out


def test_stages_equal_brute_force(spark, folder, tmp_path):
    """Each stage against a plain version on the same input; of language_id, that it keeps all with letters here."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = stages["language_id"](spark, docs, folder)
    assert rows_of(found) == sorted(((r.doc_id, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)), key=str)

    rows = docs.collect()
    expected = brute_line_stage(rows)
    kept = [(r.doc_id, expected[r.doc_id, r.text][0]) for r in rows if expected[r.doc_id, r.text] is not None]
    assert rows_of(stages["line_dedup"](spark, docs, folder)) == sorted(kept, key=str)

    classes = brute_classes(rows)
    one_of_each = {(r.doc_id, r.text) for r in rows if classes[r.doc_id] == r.doc_id}
    assert rows_of(stages["minhash"](spark, docs, folder)) == sorted(one_of_each, key=str)

    left = brute_kept(rows, 100)
    texts = []
    for r in rows:
        data, gone = left[r.doc_id, r.text or ""]
        text = None if r.text is None else data.decode("utf-8", "ignore") if gone.any() else r.text
        if not gone.any() or text.strip():
            texts.append((r.doc_id, text))
    assert rows_of(stages["suffix_dedup"](spark, docs, folder)) == sorted(texts, key=str)

    bins, words = {}, {}
    for r in stages["packing"](spark, docs, folder).collect():
        bins.setdefault((r.shard, r.bin), []).append(r)
        words[r.doc_id] = words.get(r.doc_id, 0) + r.length
    copies = [r.doc_id for r in rows]
    assert words == {r.doc_id: len((r.text or "").split()) * copies.count(r.doc_id) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    for held in bins.values():
        assert sum(r.length for r in held) <= 2048 and len({source[r.doc_id] for r in held}) == len(held)


def test_no_label_keeps_all_with_letters(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.keep_known_languages(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == docs.where("text rlike '[\\\\p{L}]'").count() > 0


def test_run_packs_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "shard", "bin", "offset", "length"} <= set(rows[0].asDict())


def test_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
