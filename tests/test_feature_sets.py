"""Feature sets from paths, folders, patterns and lists."""

import os

import numpy as np
import pytest

from pixelframe.grid import Grid
from pixelframe.sources import feature_sets, gtiff

GRID = Grid(0.0, 0.0, 1.0, 1.0, 9, 6)


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    images = {}
    for name, bands in (("b.tif", 1), ("A.tif", 2), ("c.txt", 1), ("more/d.tif", 1)):
        os.makedirs(tmp_path / "more", exist_ok=True)
        image = rng.normal(size=(6, 9, bands)).astype("f4").astype(float)
        image[2, 3, 0] = np.nan
        images[name] = image
        (tmp_path / name).write_bytes(gtiff.encode(image, GRID, tile=16, compression="deflate"))
    (tmp_path / "l.csv").write_text(f"# images\n{tmp_path}/more/d.tif, note\n\n")
    return tmp_path, images


def test_files_of_a_set(spark, folder):
    path, _ = folder
    base = {"name": "s", "type": "ordinal"}
    names = lambda *files: [f.rsplit("/", 1)[-1] for f in feature_sets.expand(spark, {**base, "files": list(files)}).files]
    assert names({"directory": str(path)}) == ["A.tif", "b.tif"]
    assert names({"glob": f"{path}/*.t*"}) == ["A.tif", "b.tif", "c.txt"]
    assert names({"list": f"{path}/l.csv"}, {"path": f"{path}/b.tif"}, {"path": f"{path}/b.tif"}) == ["b.tif", "d.tif"]
    for wrong in ({"files": [{"other": "x"}]}, {"files": []}, {"type": "thing", "files": [{"path": "x"}]}, {"files": [{"path": "p/x.tif"}, {"path": "q/x.tif"}]}):
        with pytest.raises(ValueError):
            feature_sets.expand(spark, {**base, **wrong})


def test_covariates_of_all_sets(spark, folder):
    path, images = folder
    sets = [feature_sets.expand(spark, {"name": "one", "type": "ordinal", "files": [{"directory": str(path)}]}), feature_sets.expand(spark, {"name": "two", "type": "categorical", "files": [{"list": f"{path}/l.csv"}]})]
    wide, grid, columns = feature_sets.covariates(spark, sets)
    assert grid == GRID and columns == ["A", "A_1", "b", "d"]
    rows = wide.collect()
    assert len(rows) == 54
    for r in rows:
        for c, (name, band) in zip(columns, (("A.tif", 0), ("A.tif", 1), ("b.tif", 0), ("more/d.tif", 0)), strict=True):
            v = images[name][r["py"], r["px"], band]
            assert r[c] is None if np.isnan(v) else np.isclose(r[c], v)
    found = {r["feature"]: (r["pixels"], round(r["missing"], 6)) for r in feature_sets.missing(wide, columns).collect()}
    assert found == {"A": (53, round(100 / 54, 6)), "A_1": (54, 0.0), "b": (53, round(100 / 54, 6)), "d": (53, round(100 / 54, 6))}
    assert sorted(feature_sets.resolutions(sets).values()) == [(9, 6, 1), (9, 6, 1), (9, 6, 2)]
    (path / "more" / "e.tif").write_bytes(gtiff.encode(images["b.tif"], Grid(5.0, 0.0, 1.0, 1.0, 9, 6)))
    with pytest.raises(ValueError, match="another grid"):
        feature_sets.covariates(spark, [*sets, feature_sets.expand(spark, {"name": "x", "type": "ordinal", "files": [{"path": f"{path}/more/e.tif"}]})])
