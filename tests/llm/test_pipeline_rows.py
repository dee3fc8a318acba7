import corpus_pipeline as C

ROWS = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (None, "a b c d e f g", "y"), (2, "other words than those before", None), (3, None, "z")]


def kept(df):
    return sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())


def test_a_written_table_is_not_written_again(spark, tmp_path, monkeypatch):
    names, plain = [], C.fresh_path
    monkeypatch.setattr(C, "fresh_path", lambda session, what: names.append(what) or plain(session, what))
    given = spark.createDataFrame(ROWS, "doc_id long, text string, license string")
    given.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    expected = [(1, "a b c d e f g"), (2, "other words than those before"), (3, "")]
    out = C.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and kept(out) == expected and names == []
    assert kept(C.near_dedup_stage(spark, given, "")) == expected and names == ["near-dedup-contents"]
    assert kept(C.near_dedup_stage(spark, docs.union(docs), "")) == [*expected, (3, "")] and len(names) == 2  # a NULL text is nobody's copy
    assert kept(C.near_dedup_stage(spark, docs.where("false"), "")) == []
