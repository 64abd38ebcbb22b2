"""Every command once, on a small CSV."""

from __future__ import annotations

import math
import random

import pytest

from fieldkrig.cli import COMMANDS, main
from fieldkrig.functions.models import single
from fieldkrig.operators.cokriging import Lmc
from fieldkrig.sources import gpkg
from fieldkrig.sources.points import Grid, write_model


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d, r = tmp_path_factory.mktemp("cli"), random.Random(12345)
    rows = [(r.uniform(0, 100), r.uniform(0, 100)) for _ in range(80)]
    head = "x,y,value,secondary,c,code\n"
    line = lambda x, y: f"{x},{y},{math.sin(x / 15) + math.cos(y / 20) + 5},{math.sin(x / 15) + 5},{x / 100 + r.random()},{int(x > 50)}\n"
    (d / "p.csv").write_text(head + "".join(line(x, y) for x, y in rows))
    (d / "t.csv").write_text(head + "".join(line(x + 1.5, y) for x, y in rows[:10]))
    write_model(single("exponential", 1.0, 30.0, 0.05), str(d / "m.json"))
    write_model(single("exponential", 0.2, 30.0, 0.02), str(d / "i.json"))
    return d


RUNS = {
    "variogram": [["--fit", "spherical,exponential", "--n-lags", "8"], ["--detrend", "1", "--azimuth", "30"]],
    "vmap": [["--n-lags", "3"]],
    "krige": [["--model", "m.json", "--nx", "5", "--ny", "5"], ["--model", "m.json", "--nx", "4", "--ny", "4", "--block", "5,5", "--max-neighbors", "12"], ["--model", "m.json", "--targets", "t.csv", "--covariates", "c"], ["--model", "m.json", "--targets", "t.csv", "--vecchia"], ["--model", "m.json", "--nx", "3", "--ny", "3", "--lognormal"]],
    "cokrige": [["--nx", "3", "--ny", "3", "--n-lags", "6", "--max-neighbors", "8"]],
    "collocated-cokrige": [["--model", "m.json", "--targets", "t.csv"]],
    "cv": [["--model", "m.json", "--folds", "4"]],
    "sgs": [["--model", "m.json", "--nx", "4", "--ny", "4", "--realizations", "2"]],
    "tgs": [["--model", "m.json", "--value", "code", "--nx", "4", "--ny", "4", "--realizations", "2"]],
    "sis": [["--model", "i.json", "--nx", "4", "--ny", "4", "--realizations", "2"]],
    "declus": [["--cell", "20"]],
    "ik": [["--model", "i.json", "--nx", "4", "--ny", "4"]],
    "rk": [["--model", "m.json", "--targets", "t.csv", "--covariates", "c"]],
    "compare": [["--model", "m.json"]],
    "tune": [["--what", "knn"]],
}


@pytest.mark.parametrize("command", RUNS)
def test_command(spark, files, command, capsys):
    for args in RUNS[command]:
        paths = [str(files / a) if a.endswith((".json", ".csv")) else a for a in args]
        assert main([command, str(files / "p.csv"), *paths], spark) == 0, capsys.readouterr().err


def test_geopackage_commands(spark, files, capsys):
    path = str(files / "a.gpkg")
    gpkg.write_points(spark.createDataFrame([(10.0, 10.0, 1.0)], "x double, y double, v double"), path, "pts")
    grid = Grid.from_bbox((0, 0), (100, 100), (4, 4))
    gpkg.write_raster(grid.frame(spark).selectExpr("ix", "iy", "double(node) as value"), grid, path, "ras")
    assert main(["gpkg-info", path], spark) == 0
    assert main(["gpkg-sample", str(files / "t.csv"), "--raster", path, "--raster-layer", "ras"], spark) == 0
    assert set(RUNS) | {"gpkg-info", "gpkg-sample"} == set(COMMANDS)


def test_errors_are_reported(spark, files, capsys):
    assert main(["krige", str(files / "p.csv"), "--value", "nope", "--model", str(files / "m.json")], spark) == 1
    assert "there are: x, y" in capsys.readouterr().err
    assert main(["variogram", str(files / "p.csv"), "--estimator", "madogram", "--fit", "best"], spark) == 1


def test_lmc_text():
    lmc = Lmc.from_json('{"nugget": [[0.1, 0], [0, 0.1]], "structures": [{"kind": "spherical", "range": 5, "sills": [[1, 0.5], [0.5, 1]]}]}')
    assert Lmc.from_json(lmc.to_json()).sills.tolist() == lmc.sills.tolist()
