"""FX3: export presets, options and writers."""

import json
import os
import tempfile

import pytest

from encore.operators import export as ex


def test_preset_counts(fx3):
    assert ex.export(fx3, "plays").count() == 3
    assert ex.export(fx3, "tracks").count() == 3
    assert ex.export(fx3, "albums").count() == 2
    assert ex.export(fx3, "artists").count() == 2
    assert ex.export(fx3, "plays", limit=2).count() == 2
    r = ex.export(fx3, "plays", limit=1, columns=["track_title", "timestamp"])
    assert r.columns == ["track_title", "timestamp"] and r.count() == 1
    arts = {r.name: r for r in ex.export(fx3, "artists").collect()}
    assert (arts["The Beatles"].album_count, arts["The Beatles"].track_count, arts["The Beatles"].play_count) == (1, 2, 2)


def test_sampling_is_reproducible(fx3):
    a = [r.id for r in ex.export(fx3, "tracks", sample=0.5, seed=11).collect()]
    b = [r.id for r in ex.export(fx3, "tracks", sample=0.5, seed=11).collect()]
    assert a == b
    assert ex.export(fx3, "tracks", sample=1.0).count() == 3
    for share in (0.0, -0.1, 1.5):
        with pytest.raises(ValueError, match="share"):
            ex.export(fx3, "tracks", sample=share)
    with pytest.raises(ValueError, match="seed"):
        ex.export(fx3, "tracks", seed=1)


def test_writers(fx3, spark):
    out = tempfile.mkdtemp(prefix="encore-export-")
    n = ex.write_output(ex.export(fx3, "tracks"), os.path.join(out, "csv"), fmt="csv")
    assert n == 3
    text = "".join(open(os.path.join(out, "csv", f)).read() for f in sorted(os.listdir(os.path.join(out, "csv"))) if f.endswith(".csv"))
    assert text.splitlines()[0].startswith("id,title")
    ex.write_output(ex.export(fx3, "tracks"), os.path.join(out, "nohdr"), fmt="tsv", no_headers=True)
    body = "".join(open(os.path.join(out, "nohdr", f)).read() for f in os.listdir(os.path.join(out, "nohdr")) if f.endswith(".csv"))
    assert "id\ttitle" not in body and len(body.splitlines()) == 3
    assert ex.write_output(ex.export(fx3, "plays"), os.path.join(out, "arr"), fmt="json") == 3
    for rows in (ex.export(fx3, "plays"), ex.export(fx3, "plays").limit(0)):
        ex.write_output(rows, os.path.join(out, "doc"), fmt="json")
        parts = sorted(p for p in os.listdir(os.path.join(out, "doc")) if p.startswith("part-"))
        text = "".join(open(os.path.join(out, "doc", p)).read() for p in parts)
        assert [r["track_id"] for r in json.loads(text)] == [r.track_id for r in rows.collect()]
    assert "Physical Plan" in ex.dry_run(ex.export(fx3, "plays"))
