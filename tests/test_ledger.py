"""Datasets are processed exactly once, wherever a batch breaks off."""

import json

import pytest

from geoloom.streaming import features as stream


@pytest.mark.parametrize("where", ["fn", "rename"])
def test_a_broken_batch_goes_on(spark, tmp_path, monkeypatch, where):
    landing, done, check = (str(tmp_path / n) for n in ("landing", "done", "check"))
    calls, rename = [], stream.rename

    def land(name, *keys):
        (tmp_path / "landing").mkdir(exist_ok=True)
        (tmp_path / "landing" / name).write_text("\n".join(json.dumps({"dataset": k, "v": name}) for k in keys))

    def fn(rows):
        calls.append(sorted(tuple(r) for r in rows.collect()))
        if where == "fn" and len(calls) == 1:
            raise RuntimeError("broken off")
        return rows

    def broken(*args):
        if where == "rename" and len(calls) == 1:
            raise RuntimeError("broken off")
        rename(*args)

    monkeypatch.setattr(stream, "rename", broken)
    run = lambda c=check: stream.process_new(spark, landing, done, fn, c, "dataset string, v string").awaitTermination()
    land("a.json", "x", "y", "x", None)
    with pytest.raises(Exception, match="broken off"):
        run()
    run()
    assert calls[0] == calls[1] == [("x", "a.json"), ("y", "a.json")]
    land("b.json", "y", "z")
    run()
    run(check + "-new")  # another checkpoint sees all files again
    got = sorted(tuple(r) for r in stream.processed(spark, done).select("dataset", "v").collect())
    assert got == [("x", "a.json"), ("y", "a.json"), ("z", "b.json")]
