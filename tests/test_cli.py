import json

import pytest

from tessera import cli


@pytest.fixture
def store(tmp_path):
    for name, ext, value in (("user_prompt", ".txt", "p {}"), ("report", ".txt", "r"), ("json", ".json", '{{"a":{}}}'), ("json_schema", ".json", '{{"type":"object"}}')):
        (tmp_path / name).mkdir()
        for k in range(10):
            (tmp_path / name / f"d{k}{ext}").write_text(value.format("x " * 20 * k if name == "user_prompt" else k).replace("{{", "{").replace("}}", "}"))
    return tmp_path


def test_commands(spark, store, capsys):
    at = str(store)
    cli.main(["split", "--input", f"{at}/user_prompt", "--output", f"{at}/split.txt"])
    assert len((store / "split.txt").read_text().split("\n")) == 1
    cli.main(["audit", f"{at}/json", f"{at}/json_schema"])
    cli.main(["lengths", "--input", f"{at}/user_prompt"])
    cli.main(["number", f"{at}/json", f"{at}/json_schema"])
    assert '"new_stem":"data-10"' in capsys.readouterr().out
    cli.main(["collect", at, f"{at}/wide"])
    cli.main(["export", f"{at}/wide", f"{at}/back"])
    assert (store / "back/json/d3.json").read_text() == '{"a":3}'
    cli.main(["prune", at, "--max-tokens", "100", "--dry-run"])
    assert "d9.txt" in capsys.readouterr().out and (store / "report/d9.txt").exists()
    (store / "rows.jsonl").write_text(json.dumps({"stem": "a", "pred_json": '{"a":1}', "gold_json": '{"a":1}', "json_schema": '{"type":"object"}'}) + "\n")
    cli.main(["evaluate", "--input", f"{at}/rows.jsonl", "--output", f"{at}/e.xlsx"])
    assert '"exact_match":1.0' in capsys.readouterr().out
    cli.main(["sparse", at])
    (store / "s.jsonl").write_text('{"json_schema":"{}","unique_id":"1"}\n{"json_schema":"{\\"type\\":\\"integer\\"}","unique_id":"2"}\n')
    for kind in ("prompts", "answers", "pairs"):
        cli.main(["schema-sets", kind, f"{at}/s.jsonl", f"{at}/{kind}"])
    assert spark.read.json(f"{at}/answers").count() == 1
    (store / "m.jsonl").write_text(json.dumps({"system": "SYSTEM: s", "chat": 'USER: q\n\n\nASSISTANT: {"a":1}'}) + "\n")
    (store / "t.jsonl").write_text(json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": '<tool_call>{"a":1}</tool_call>'}]}) + "\n")
    cli.main(["tool-calls", f"{at}/m.jsonl", f"{at}/t.jsonl", f"{at}/calls.json"])
    assert len(json.loads((store / "calls.json").read_text())) == 2
    cli.main(["check", "--data", f"{at}/calls.json"])
    cli.main(["registry", f"{at}/r.json", "x", "calls.json"])
    assert "x" in json.loads((store / "r.json").read_text())
