import csv
import glob
import json

from sievework import cli
from sievework.plans.planner import Settings, read_env_file
from sievework.session import healthy


def lines(folder):
    out = []
    for path in sorted(glob.glob(f"{folder}/part-*.csv")):
        with open(path, newline="", encoding="utf-8") as f:
            out += list(csv.DictReader(f))
    return out


def test_noise_and_prompt(spark, tmp_path, capsys):
    with open(tmp_path / "clean.csv", "w", encoding="utf-8") as f:
        f.write("hotel,adults,country,adr,reservation_status_date\n")
        for i in range(100):
            f.write(f"City Hotel,{i % 4},C{i % 5},{i}.5,2015-07-{i % 28 + 1:02d}\n")
    assert cli.main(["noise", "--input", str(tmp_path / "clean.csv"), "--output_dir", str(tmp_path / "out")]) == 0
    for level, rate in (("low", 0.05), ("medium", 0.1), ("high", 0.2)):
        log = lines(tmp_path / "out" / f"injected_errors_{level}.csv")
        assert sum(r["column"] == "country" for r in log) == int(100 * rate)
        assert len(lines(tmp_path / "out" / f"noisy_{level}.csv")) == 100
    profile = {r["column"]: r for r in lines(tmp_path / "out" / "profile_clean.csv")}
    assert profile["adr"]["dtype_detected"] == "numeric" and json.loads(profile["hotel"]["top_values"])[0] == {"value": "City Hotel", "n": 100}
    capsys.readouterr()
    assert cli.main(["prompt", "--dataset", str(tmp_path / "clean.csv"), "--approach", "schema"]) == 0
    assert "- adults (numeric): examples 0, 1, 2" in capsys.readouterr().out


def test_run_and_health(spark, tmp_path, capsys):
    (tmp_path / "s.py").write_text("print(1)")
    assert cli.main(["run", str(tmp_path / "s.py"), "--log", str(tmp_path / "log.json")]) == 0
    assert json.loads(capsys.readouterr().out)["stdout"] == "1\n"
    assert json.loads((tmp_path / "log.json").read_text())["script_path"].endswith("s.py")
    assert healthy(spark) == {"status": "ok"}


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# x\nSIEVEWORK_PROVIDER=cloud\nSIEVEWORK_KEY='k'\n\n")
    assert read_env_file(str(tmp_path / ".env")) == {"SIEVEWORK_PROVIDER": "cloud", "SIEVEWORK_KEY": "k"}
    monkeypatch.setenv("SIEVEWORK_MODEL", "m")
    assert Settings.from_environment() == Settings(model="m")
