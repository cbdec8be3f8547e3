import json

from quarry.__main__ import main


def test_index_and_search(spark, tmp_path, capsys):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.html").write_text('<title>Apples</title><p>Red apples.</p><a href="b.html">b</a>')
    (folder / "b.html").write_text("<title>Pears</title><p>Green pears and apples.</p>")
    (folder / "manifest.json").write_text('{"a.html": "http://e.com/a.html", "b.html": "http://e.com/b.html"}')
    main(["index", str(folder), str(tmp_path / "index")])
    main(["search", str(tmp_path / "index"), "pears"])
    answer = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [r["url"] for r in answer["results"]] == ["http://e.com/b.html"]
    (tmp_path / "judged.json").write_text('{"queries": {"pears": ["http://e.com/b.html"], "none": ["http://e.com/x"]}}')
    main(["evaluate", str(tmp_path / "index"), str(tmp_path / "judged.json")])
    out = capsys.readouterr().out
    assert "none" in out and "1.0" in out
