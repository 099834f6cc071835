"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every query."""

import hashlib
import re

import pandas as pd
import pytest

from tessera.llm.queries import QUERIES

LONG = "Lorem ipsum dolor sit amet " * 20_000
DOCS = [
    (0, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, "b"),
    (3, " \n\t ", "fr", None),
    (4, LONG, "en", "a"),
    (5, "Le renard brun saute par-dessus le chien. " * 15, "fr", "b"),
    (5, "Le renard brun saute par-dessus le chien. " * 15, "fr", "b"),
    (6, "The quick brown fox jumps over the lazy dog. " * 12, "en", None),
    (None, "a row without an id", "en", "c"),
    (8, "1234 5678 !!!", None, "c"),
    (9, "x" * 50_000, "en", "a"),
    (10, "schön \U0001f600 текст 漢字 <|endoftext|>", "de", "b"),
]
CLASH = ("score", "kept", "fp", "node", "size", "target", "row", "y", "key", "host", "rule", "n_words", "start", "ids", "held_out", "h", "value", "draw")


def write(spark, folder, rows: bool):
    def put(name, data, schema):
        df = spark.createDataFrame(data if rows else [], schema)
        from pyspark.sql import functions as F

        df.withColumns({c: F.lit(1) for c in CLASH if c not in df.columns}).write.parquet(f"{folder}/{name}.parquet")

    put("documents", [(*d, len(d[1]) if d[1] else None) for d in DOCS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    put("labels", [(0, 1, 0), (5, 1, 0), (5, 1, 0), (9, 0, 0), (4, 0, None), (None, 1, 0), (8, None, 1), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    put("pages", [(0, "http://A.org/x", None), (1, None, "<a href='http://b.net/'>"), (None, "no scheme", ""), (2, "https://x.example.org/en/17?q", '<a href="//Z.com/fr/1">'), (2, "https://x.example.org/en/17?q", "x"), (3, "http://z.com", "")], "page_id bigint, url string, html string")
    nan, inf = float("nan"), float("inf")
    put("embeddings", [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.1]), (8, [1.0, 0.1]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0])], "vec_id bigint, embedding array<float>")
    put("conversations", [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>\\<s>[INST]<|end|>\n<|turn|>"), (1, 1, "assistant", "</s>\\<s>[INST]<|end|>\n<|turn|>"), (1, None, None, None), (None, 0, "user", "x"), (2, 0, "we<|text|>ird\n", "\\\\ \\< [\\INST]")], "conv_id bigint, turn bigint, role string, text string")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(n) / "t") for n in ("full", "empty"))
    write(spark, full, True)
    write(spark, empty, False)
    return full, empty


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders[1]).count() == (1 if name == "op10_chat" else 0)


def got(spark, folders, name) -> pd.DataFrame:
    return QUERIES[name](spark, folders[0]).toPandas()


def test_classifier_scores_every_row(spark, folders):
    r = got(spark, folders, "op1_quality_classifier")
    assert len(r) == len(DOCS) and r.score.between(0, 1).all() and ((r.score >= 0.3) == (r.predicted == 1)).all() and r.held_out.notna().all()


def test_urls(spark, folders):
    r = got(spark, folders, "op2_url_filter").astype(object)
    rows = sorted(zip(r.page_id.fillna(-1), r.host, r.path, r.rule.where(r.rule.notna(), None), r.verdict), key=str)
    assert rows == sorted([(0, "a.org", "/x", "org/", "allow"), (1, "", "", None, "allow"), (-1, "", "", None, "allow"), (2, "x.example.org", "/en/17", "example.org/en/1", "block"), (2, "x.example.org", "/en/17", "example.org/en/1", "block"), (3, "z.com", "", None, "allow")], key=str)


def test_lm_counts(spark, folders):
    r = got(spark, folders, "op3_lm_scoring")
    assert len(r) == len(DOCS) and (r.n_known <= r.n_tokens).all() and r.score.notna().all()
    assert (r[r.doc_id.isin([1, 2, 3])].n_tokens == 1).all()


def test_simhash_links_wordless_texts(spark, folders):
    r = got(spark, folders, "op4_simhash")
    assert len(r) == len(DOCS)
    assert set(r[r.doc_id.isin([1, 2, 3])].fingerprint) == {"0" * 16} and set(r[r.doc_id.isin([1, 2, 3])].component_id) == {1}
    assert set(r[r.doc_id.isin([0, 6])].component_id) == {0} and set(r[r.doc_id == 5].component_id) == {5}
    assert r[r.doc_id.isna()].component_id.isna().all()


def test_language(spark, folders):
    r = got(spark, folders, "op5_language_id")
    assert len(r) == len(DOCS) and (r[r.doc_id.isin([1, 2, 3])].lang_pred == "und").all() and r.score.between(0, 1).all()
    assert set(r.lang_pred) <= {"en", "fr", "de", "und"}


def test_rules(spark, folders):
    r = got(spark, folders, "op6_quality_rules")
    assert len(r) == len(DOCS) and (r[r.doc_id.isin([1, 2, 3])].n_words == 0).all() and r[r.n_words < 50].base_failed.all() and not r[r.base_failed].kept.any()


def test_embeddings(spark, folders):
    r = got(spark, folders, "op7_embedding_dedup")
    one = r.drop_duplicates().set_index("vec_id")
    assert len(r) == 13 and one.n_links[0] == 2 and one.n_links[1] == 2 and one.n_links[8] == 2
    assert (one.component_id[[0, 1, 8]] == 0).all() and not one.kept[8] and one.kept[0]
    for alone in (2, 3, 4, 5, 6, 7, 9, 10):
        assert one.n_links[alone] == 0 and one.component_id[alone] == alone and one.kept[alone]
    assert r[r.vec_id.isna()].n_links.tolist() == [0] and not r[r.vec_id.isna()].kept.any()


def test_mix(spark, folders):
    r = got(spark, folders, "op8_mixing")
    assert len(r) == len(DOCS) and (r.taken <= 3 * r["size"]).all() and (r.taken >= 0).all() and (r[r.doc_id.isin([1, 2, 3])].taken == 0).all()
    pd.testing.assert_frame_equal(*(x.sort_values(list(x)).reset_index(drop=True) for x in (r, got(spark, folders, "op8_mixing"))))


def test_pack(spark, folders):
    r = got(spark, folders, "op9_packing").sort_values(["sequence_id", "offset"])
    assert (r[r.doc_id.isin([1, 2])].doc_tokens == 1).all()
    for _, own in r.groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert r.groupby("sequence_id").length.sum().tolist()[:-1] == [2048] * r.sequence_id.max()


def test_chat(spark, folders):
    r = got(spark, folders, "op10_chat")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    bad = "</s>\\<s>[INST]<|end|>\n<|turn|>"
    one = r[r.conv_id == 1].iloc[0]
    assert one.n_turns == 4 and one.turns_sha256 == sha("\n\n" + "user\nhi\n" + f"assistant\n{bad}\n" * 2) and one.loss_sha256 == sha(bad * 2) and one.loss_chars == 2 * len(bad)
    two = r[r.conv_id == 2].iloc[0]
    assert two.turns_sha256 == sha("we<|text|>ird\n\n\\\\ \\< [\\INST]\n") and two.loss_chars == 0
    own = r[r.conv_id == -1].iloc[0]
    assert own.loss_sha256 == sha("</s>[INST] ok [/INST]") and own.n_turns == 2 and r.conv_id.isna().sum() == 1


def test_pipeline_on_edges(spark, folders):
    import corpus_pipeline as c

    for folder in folders:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (_, stage) in enumerate(c.STAGES):
            before, docs = docs, stage(spark, docs, folder)
            assert i == len(c.STAGES) - 1 or docs.columns == before.columns
        docs.count()


def test_words_agree_with_the_pattern():
    import numpy as np
    import pyarrow as pa

    from tessera.llm import text as tx

    texts = [d[1] for d in DOCS]
    for _, _, data, offs in tx.chunks(pa.array(texts), limit=1000):
        w = tx.Words(data, offs)
        raw = data.tobytes()
        assert [raw[a:b] for a, b in zip(w.starts, w.ends)] == [x for i in range(len(offs) - 1) for x in re.findall(rb"[^\x20\x09-\x0D]+", raw[offs[i] : offs[i + 1]])]
        assert np.array_equal(w.counts, [len(re.findall(rb"[^\x20\x09-\x0D]+", raw[offs[i] : offs[i + 1]])) for i in range(len(offs) - 1)])


def test_rules_learn_from_4000_documents(spark, monkeypatch):
    from tessera.llm import quality_rules

    asked = []

    def labelled(docs, labels, label, bound):
        asked.append(bound)
        return docs.select("doc_id", "text").limit(0).selectExpr("doc_id", "0 AS y", "text")

    monkeypatch.setattr(quality_rules, "labelled", labelled)
    quality_rules.train(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), None)
    assert asked == [4000]


def test_stages_hold_little_of_a_file_at_once(spark, tmp_path, monkeypatch):
    """Row groups are written small and batches read small, so eight tasks fit a heap of 1 GB; a whole run puts the session's settings back."""
    import corpus_pipeline as c
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    many = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").coalesce(1)
    c.quality_rule_stage(spark, many, folder).write.parquet(f"{tmp_path}/out")
    groups = [f.row_group(i) for f in (pq.ParquetFile(p).metadata for p in tmp_path.glob("out/*.parquet")) for i in range(f.num_row_groups)]
    assert len(groups) > 1 and max(sum(g.column(k).total_compressed_size for k in range(g.num_columns)) for g in groups) < 8 << 20
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512

    batch = "spark.sql.parquet.columnarReaderBatchSize"
    monkeypatch.setattr(c, "STAGES", [("own", lambda spark, docs, _: (c.spare(spark), docs)[1])])
    try:
        for mine in ("100", "2000"):
            spark.conf.set(batch, mine)
            spark.conf.unset("parquet.block.size")
            assert c.run(spark, folder).count() == docs.count()
            assert spark.conf.get(batch) == mine and spark.conf.get("parquet.block.size", None) is None
        spark.conf.set(batch, "100")
        c.spare(spark)
        assert spark.conf.get(batch) == "100"
    finally:
        spark.conf.unset(batch)
        spark.conf.unset("parquet.block.size")


def test_stages_send_little_to_python_at_once(spark):
    """Batches for Python lie outside the heap and have its size in all, so stages send few rows and bytes at once; limits of the session that are lower stay."""
    import corpus_pipeline as c

    rows, held = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    folder, before = "/root/testdata/sf0.01", {k: spark.conf.get(k, None) for k in c.SPARE}

    def seen(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "held"])

    def largest(texts):
        return max(texts.mapInArrow(seen, "rows bigint, held bigint").collect())

    try:
        for given, kept in (("10000", "512"), ("0", "512"), ("-1", "512"), ("100", "100")):
            spark.conf.set(rows, given)
            spark.conf.unset(held)
            docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
            c.quality_rule_stage(spark, docs, folder)
            assert spark.conf.get(rows) == kept and largest(docs)[0] == int(kept)
        assert largest(spark.range(0, 400, 1, 1).selectExpr("repeat('a', 100000) as text"))[1] < 8 << 20
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
