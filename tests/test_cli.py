from arcweave import cli


def test_commands(spark, tmp_path, capsys):
    f = tmp_path / "cmds"
    f.write_text(f"# two runs\nbfs --gen-method 2 --gen-nodes 12 --check --output '{tmp_path}/lev els'\ncc --gen-method 3 --gen-nodes 12 --segments 3 --check\nsssp --gen-nodes 40 --gen-factor 3 --gen-weights --variant near-far --delta 50 --check\n")
    assert cli.main(["--cmdfile", str(f)]) == 0
    out = capsys.readouterr().out
    assert out.count("passed") == 3 and "components 3" in out
    parts = sorted((tmp_path / "lev els").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines()[:2] == ["0 0", "1 1"]


def test_stats_and_filter(spark, tmp_path, capsys):
    assert cli.main(["bfs", "--gen-method", "2", "--gen-nodes", "8", "--stats"]) == 0
    assert "nodes 8 edges 14" in capsys.readouterr().out
    assert cli.main(["pbf", "--size", "1000", "--check", "--output", str(tmp_path / "v")]) == 0
    assert "passed" in capsys.readouterr().out
    assert cli.main(["pr", "--gen-nodes", "30", "--gen-factor", "3", "--check", "--output", str(tmp_path / "r")]) == 0
    assert (tmp_path / "r").read_text().startswith("ALPHA 0.85")
