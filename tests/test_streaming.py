import json

from tests.conftest import AS_OF


def test_stream_imports_new_files_once(spark, tmp_path):
    from memlake.streaming import start_import_stream
    watch = tmp_path / "in"
    watch.mkdir()
    (watch / "a.json").write_text(json.dumps([{"memory": "Grows tomatoes."}, {"memory": "Grows tomatoes."},
                                              {"memory": ""}]))
    table = str(tmp_path / "table")
    ckpt = str(tmp_path / "ckpt")
    q = start_import_stream(spark, str(watch), table, "chatgpt", ckpt, as_of=AS_OF, available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 1
    assert spark.read.parquet(table + "_rejects").count() == 1
    (watch / "b.json").write_text(json.dumps([{"memory": "Grows tomatoes."}, {"memory": "Keeps a diary."}]))
    q = start_import_stream(spark, str(watch), table, "chatgpt", ckpt, as_of=AS_OF, available_now=True)
    q.awaitTermination(120)
    got = sorted(r["content"] for r in spark.read.parquet(table).collect())
    assert got == ["Grows tomatoes.", "Keeps a diary."]


def test_batches_read_keys_and_no_stored_text(spark, tmp_path, monkeypatch):
    from memlake.sources.keys import KeyTable
    from memlake.streaming import ingest
    table = str(tmp_path / "table")

    def batch(n, *texts):
        rows = [(f"f{n}.json", json.dumps([{"memory": t} for t in texts]))]
        ingest.import_batch(spark.createDataFrame(rows, "file string, value string"), table, "chatgpt", AS_OF, n)
        return sorted(r["content"] for r in spark.read.parquet(table).collect())

    assert batch(0, "Grows tomatoes.", "Grows tomatoes.") == ["Grows tomatoes."]
    keys, stored = KeyTable(spark, table + "_keys"), ingest._stored
    assert keys.in_step() and keys.read().count() == 1

    def unread(*_):
        raise AssertionError("stored texts were read")
    monkeypatch.setattr(ingest, "_stored", unread)
    assert batch(1, "Keeps a diary.", "Grows tomatoes.") == ["Grows tomatoes.", "Keeps a diary."]
    # A job that ended between records and keys: the next batch, or its own second try, makes the missing keys.
    monkeypatch.setattr(ingest, "_stored", stored)
    monkeypatch.setattr(KeyTable, "append", lambda *_: 1 / 0)
    try:
        batch(2, "Plays chess.")
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert not keys.in_step()
    assert batch(2, "Plays chess.") == ["Grows tomatoes.", "Keeps a diary.", "Plays chess."]
    assert keys.in_step() and keys.read().distinct().count() == keys.read().count() == 3
