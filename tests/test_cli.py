import numpy as np

from tickweir.__main__ import main, parser, settings


def test_defaults_are_those_of_each_study():
    s = {w: settings(parser().parse_args([w, "--roots", "x"])) for w in ("attribution", "comparison", "targets", "diagnose")}
    assert (s["attribution"].seq_len, s["attribution"].n_folds, s["attribution"].alpha, s["attribution"].subsample) == (32, 4, 0.0, 0)
    assert [s[w].subsample for w in ("comparison", "targets", "diagnose")] == [80_000, 60_000, 100_000] and s["comparison"].horizon_events == 50
    assert settings(parser().parse_args(["targets", "--roots", "x", "--balance", "--models", "ridge"])).models == ("ridge",)


def test_generate_and_study(spark, tmp_path, capsys):
    main(["generate", "--out", str(tmp_path / "g"), "--n-markets", "3", "--minutes", "10", "--kappa", "1.0"], spark)
    common = ["--roots", str(tmp_path / "g"), "--min-rows", "50", "--n-tiers", "1", "--seq-len", "4", "--n-folds", "2", "--grid-k", "3", "--min-mid-moves", "5"]
    main(["attribution", *common, "--horizon-s", "5", "--phases", "01", "--models", "ridge", "--tasks", "reg"], spark)
    out = capsys.readouterr().out
    assert "phase0" in out and "phase1" in out and "gain" in out and "ridge" in out
    main(["diagnose", *common, "--horizon-s", "5", "--phases", "1"], spark)
    assert "calibration" in capsys.readouterr().out


def test_convert(spark, tmp_path, capsys):
    np.savetxt(tmp_path / "x.txt", np.random.default_rng(0).uniform(1, 2, (40, 5)))
    main(["convert", "--paths", str(tmp_path / "x.txt"), "--out", str(tmp_path / "out")], spark)
    assert spark.read.parquet(f"{tmp_path}/out/x.parquet").count() == 5
