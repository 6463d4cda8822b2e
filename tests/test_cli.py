import json

from tests.conftest import DATA
from tidewater.__main__ import main


def test_commands(spark, tmp_path, capsys):
    p = tmp_path / "t.csv"
    p.write_text("id,amount,status\n" + "\n".join(f"{i},{10 + i % 3},{'ok' if i % 4 else 'late'}" for i in range(30)) + "\n99,1000,odd\n")
    assert main(["tabular", str(p), "--run-id", "r1"], spark) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["run_id"] == "r1" and made["candidate_anomalies"][0]["row_index"] == 31
    assert main(["tabular", str(p), "--format", "markdown"], spark) == 0 and capsys.readouterr().out.startswith("# tabular findings")
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text("{")
    assert main(["validate-reports", str(tmp_path / "r")], spark) == 1
    assert json.loads(capsys.readouterr().out)["errors"] == ["Report is not valid JSON."]
    assert main(["query", "auroc", str(DATA / "sf0.001")], spark) == 0 and "auroc" in capsys.readouterr().out
    assert main(["query", "nothing", str(DATA / "sf0.001")], spark) == 2 and json.loads(capsys.readouterr().err)["code"] == "engine_error"
    assert main(["tabular", str(tmp_path / "no.csv")], spark) == 2 and "no such file" in json.loads(capsys.readouterr().err)["message"]
    (tmp_path / "o.json").write_text('{"discovery": {"max_anomalies": 1}}')
    assert main(["--options", str(tmp_path / "o.json"), "tabular", str(p)], spark) == 2 and json.loads(capsys.readouterr().err)["code"] == "configuration_error"
    assert main(["dashboard", str(tmp_path / "none.jsonl")], spark) == 0
