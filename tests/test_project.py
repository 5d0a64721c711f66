"""A small project on disk, end to end: scan, validate, trace, impact, change report, publish, edits."""

import subprocess

import pytest
from pyspark.sql.functions import col as column

from threadloom import metamodel, model
from threadloom.plans import apply, project, publish, report
from threadloom.sources import config, files, git, history

RULES = """
artifact SYS:
    id is string as SYS-{num:3}
    attribute contents is mandatory string
artifact REQ:  # requirements
    id is string as REQ-{num:3}
    attribute contents is mandatory string
    attribute status is mandatory enum [draft, active]
    attribute parent is mandatory reference to parent
    attribute tag is optional multiple string
trace from REQ to SYS is mandatory via timestamp
"""
SYS = "# Systems\n\n[SYS]\nThe system flies.\n[id] SYS-001\n\nSome prose.\n\n[SYS]\nIt lands.\n[id] SYS-002\n\n[SYS]\nAgain.\n[id] SYS-001\n"
REQ = "[REQ]\nFly high.\n\nVery high, TBD.\n[id] REQ-001\n[parent] SYS-001\n```yaml\nattrs:\n  status: active\n  tag: [a, b]\n```\n\n[NOTE n1]mind this[/NOTE]\n\n[REQ]\nLand.\n[id] REQ-2\n[parent] SYS-009\n[status] odd\n\n"


@pytest.fixture()
def home(tmp_path):
    for name, text in (("SYS/a.md", SYS), ("REQ/b.md", REQ), ("REQ/2. part/c.md", "[REQ]\nno id\n[status] draft\n"), (".tl/project.model", RULES)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    (tmp_path / ".tl/config.toml").write_text(
        'base = ".."\n[metamodel]\nfilename = "project.model"\n[[input]]\nname = "sys"\ndir = "SYS"\ndriver = "obsidian"\natype = "SYS"\n'
        '[[input]]\nname = "req"\ndir = "REQ"\ndriver = "obsidian"\natype = "REQ"\nmarkers = ["NOTE"]\n', encoding="utf-8",
    )
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b.c", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "n")
    run("add", ".")
    run("commit", "-qm", "one")
    return tmp_path


def test_validation_and_matrices(spark, home):
    p = project.Project.load(spark, home / ".tl/config.toml")
    got = {(r.code, r.artifact_id) for r in p.violations().collect()}
    assert got == {
        ("duplicate_id", "SYS-001"), ("no_id", model.UNDEFINED), ("bad_enum", "REQ-2"), ("id_schema", "REQ-2"), ("dangling_reference", "REQ-2"), ("missing_trace", "REQ-2"),
    }
    assert {r.code for r in p.violations(suppress_tracing=True).collect()} == {"duplicate_id", "no_id", "bad_enum", "id_schema"}
    quiet = p.analyze(suppress_tracing=True)
    assert "## Warnings (1)\n\n- reference to an unknown id: parent SYS-009 `REQ-2` at b.md:" in quiet and quiet.errors == 4
    text = p.analyze()
    assert "Warnings" not in text
    assert "## req" in text and "without verification: 100.0 %" in text and "to be defined: 50.0 %" in text
    reverse = [(r.record_number, r.lead_id, r.linked_id) for r in p.matrix("REQ", "SYS").orderBy("record_number").collect()]
    assert reverse == [(1, "SYS-001", "REQ-001"), (2, "SYS-002", "")]
    forward = p.matrix("REQ", "SYS", forward=True, attributes=["status", "tag"])
    assert report.matrix_csv(forward, True, ["status", "tag"]) == "RecordNumber,ChildID,ParentID,status,tag\n1,REQ-001,SYS-001,active,a; b\n2,REQ-2,SYS-009,odd,\n"
    assert [r.aid for r in p.search("HIGH").collect()] == ["REQ-001"] and p.content("REQ-001").startswith("# REQ-001") and p.content("none") is None
    assert [r.aid for r in p.listing(2).collect()] == ["REQ-001", "REQ-2"]


def test_publish(spark, home, tmp_path):
    p = project.Project.load(spark, home / ".tl/config.toml")
    p.plugins = [project.Plugin("up", transform_markdown=lambda t: t + "END\n")]
    paths = p.publish(tmp_path / "out")
    req = next(x for x in paths if x.name == "req.md").read_text(encoding="utf-8")
    assert req.startswith("# 2. part\n\n## c\n\n") or req.startswith("# part\n\n## c\n\n")
    assert "\n\nmind this\n\n" in req and "| status | active |" in req and req.endswith("END\n") and "\n\n\n" not in req
    assert publish.duplicate_block_ids(p.blocks).count() == 0
    assert publish.rewrite_images("![[a b.png]] ![x](i/y.png) ```\n![x](i/y.png)\n```", {"a b.png": "images/1.png", "i/y.png": "images/2.png"}) == "![](images/1.png) ![x](images/2.png) ```\n![x](i/y.png)\n```"


def test_git_sources_impact_and_change_report(spark, home):
    p = project.Project.load(spark, home / ".tl/config.toml")
    revisions = p.git_revisions()
    assert {r.aid for r in revisions.collect()} == {"SYS-001", "SYS-002", "REQ-001", "REQ-2"} and not git.is_dirty(home)
    newer = revisions.withColumn("ts", revisions.ts + spark.range(1).selectExpr("interval 1 hour as i").first().i)
    assert p.stale_links(revisions).count() == 0
    assert [(r.child_id, r.pid) for r in p.stale_links(newer.filter("aid = 'SYS-001'").unionByName(revisions.filter("aid != 'SYS-001'"))).collect()] == [("REQ-001", "SYS-001")]
    (home / "REQ/b.md").write_text(REQ.replace("status: active", "status: draft").replace("[id] REQ-2", "[id] REQ-3"), encoding="utf-8")
    (home / "REQ/new.md").write_text("[REQ]\nx\n[id] REQ-010\n", encoding="utf-8")
    assert {(r.path, r.status) for r in git.changed_files(spark, home, git.resolve(home, "HEAD"), "working").collect()} == {("REQ/b.md", "M"), ("REQ/new.md", "A")}
    assert {(r.path, r.status) for r in git.changed_files(spark, home, "working", git.resolve(home, "HEAD")).collect()} == {("REQ/b.md", "M"), ("REQ/new.md", "D")}
    text = project.changes(spark, p.config, p.rules, home, "HEAD", "working")
    assert "| artifacts | 2 | 1 | 1 |" in text and "status: `active` -> `draft`" in text and "- REQ-010" in text
    with pytest.raises(git.GitError):
        git.tag_baseline([home], "v1", "m")
    subprocess.run(["git", "-C", str(home), "add", "."], check=True)
    subprocess.run(["git", "-C", str(home), "commit", "-qm", "two"], check=True)
    assert git.tag_baseline([home, home], "v1", "m", pattern=r"v\d+") and git.git(home, "tag").strip() == "v1"
    with pytest.raises(git.GitError):
        git.tag_baseline([home], "x", "m", pattern=r"v\d+")
    paths = spark.createDataFrame([("new.md",), ("absent",)], "path string")
    assert [(r.path, r.hash_short, r.error) for r in history.last_commits(spark, home / "REQ", paths).collect()] == [("new.md", git.git(home, "rev-parse", "HEAD").strip()[:7], None)]


def test_change_report_of_ids_binaries_and_errors(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    for d in ("doc", "pic", "nb"):
        (tmp_path / d).mkdir()
    note = lambda i, t: f"[NOTE {i}] {t} [/NOTE]\n\n"
    (tmp_path / "doc/a.md").write_text(note("n1", "first") + note("n2", "second") + note("n3", "third"))
    for name in ("same", "new"):
        (tmp_path / f"pic/{name}.png").write_bytes(b"old")
        (tmp_path / f"pic/{name}.png.stmx").write_text(f"id: P-{name}\n")
    (tmp_path / "nb/x.ipynb").write_text('{"cells": []}')
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "doc/a.md").write_text(note("n3", "third") + note("n1", "first") + note("n2", "changed"))
    (tmp_path / "pic/new.png").write_bytes(b"newer")
    (tmp_path / "nb/x.ipynb").write_text("{ broken")
    records = [config.InputRecord("doc", "doc", "obsidian", marker="REQ", markers=["NOTE"], atype="REQ"), config.InputRecord("pic", "pic", "sidecar", atype="PIC"), config.InputRecord("nb", "nb", "ipynb", atype="REQ")]
    rules = project.metamodel.Metamodel()
    text = project.changes(spark, config.Config(tmp_path, records), rules, tmp_path, "HEAD", "working")
    assert "| text fragments | 0 | 0 | 1 |" in text and "modified in doc/a.md" in text and "changed" in text
    assert "| binaries | 0 | 0 | 1 |" in text and "- modified P-new: 3 B" in text and "P-same" not in text
    assert "## Errors in x.ipynb" in text and "+{ broken" in text and '-{"cells": []}' in text
    with pytest.raises(git.GitError):
        project.changes(spark, config.Config(tmp_path, [config.InputRecord("out", "..", "text", atype="REQ")]), rules, tmp_path, "HEAD", "working")


def test_other_drivers(spark, tmp_path):
    (tmp_path / "n.ipynb").write_text('{"cells": [{"cell_type": "markdown", "source": ["[REQ]\\n", "t\\n", "[id] R-1\\n"]}, {"cell_type": "code", "source": "x = 1"}]}')
    (tmp_path / "bad.ipynb").write_text("{")
    (tmp_path / "pic.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D494844520000000300000004"))
    (tmp_path / "pic.png.stmx").write_text("id: P-1\ntitle: x\n")
    (tmp_path / "lone.png").write_bytes(b"GIF89a\x05\x00\x06\x00")
    (tmp_path / "gone.png.stmx").write_text("id: P-2\n")
    of = lambda driver, pattern: project.Project(spark, config.Config(tmp_path, [])).record_blocks(config.InputRecord("r", ".", driver, filter=pattern, atype="REQ"))
    cells = {(r.path, r.kind, r.aid, r.loc.cell) for r in of("ipynb", "*.ipynb").collect()}
    assert cells == {("n.ipynb", "artifact", "R-1", 0), ("n.ipynb", "text", None, 1), ("bad.ipynb", "error", None, 0)}
    side = {(r.path, r.kind, r.aid or r.message) for r in of("sidecar", None).filter("path like '%.png'").collect()}
    assert side == {("pic.png", "artifact", "P-1"), ("lone.png", "error", "missing sidecar"), ("gone.png", "error", "orphan sidecar")}
    from threadloom.sources.scan import binaries

    assert {(r.path, r.width, r.height) for r in files.binary_properties(binaries(spark, str(tmp_path), "*.png")).collect()} == {("pic.png", 3, 4), ("lone.png", 5, 6)}


def test_small_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text(" id ;v\nA; 1\n;2\nA;3\n", encoding="utf-8")
    from threadloom.operators.edit import fill_from_mapping

    rows = files.csv_mapping(spark, str(tmp_path / "m.csv"), "id", "v", ";")
    arts = spark.createDataFrame([("A",), ("B",)], "aid string")
    assert {(r.aid, r.value, r.outcome) for r in fill_from_mapping(arts, rows, None).collect()} == {("A", "3", "mapped"), ("B", None, "skipped")}
    with pytest.raises(ValueError):
        files.csv_mapping(spark, str(tmp_path / "m.csv"), "nope", "v", ";")
    task = "---\nid: T-1\nstatus: open\nchild_revision: abc\n---\n# T\n- **Child:** C-1\n- **Parent:** P-1\n"
    frame = spark.createDataFrame([("a.md", task), ("b.md", "no"), ("c.md", "---\nid: [\n---\n")], "path string, value string")
    assert [tuple(r) for r in files.existing_tasks(frame).collect()] == [("a.md", "T-1", "open", "abc", None)]
    assert files.impact_task(frame).filter("path = 'a.md'").first().fields == {"Child": "C-1", "Parent": "P-1"}
    images = spark.createDataFrame([("x/i.png", False), ("att/i.png", True), ("a/j.png", False)], "path string, preferred boolean")
    assert {tuple(r) for r in files.first_match(spark.createDataFrame([("i.png",), ("j.png",)], "name string"), images).collect()} == {("i.png", "att/i.png"), ("j.png", "a/j.png")}


@pytest.mark.parametrize("text", [
    "artifact A:\n    id is string\n", "artifact A:\n    id is string as {num}{num}\n    attribute contents is mandatory string\n", "attribute x is mandatory string", "    id is string",
    "artifact A:\n    id is string\n    attribute contents is mandatory string\n    attribute e is mandatory enum []\n", "artifact A:\n    id is string\n    attribute contents is mandatory string if x\n",
    "artifact A:\n    id is string\n    attribute contents is mandatory string\n    attribute b is mandatory string if nope\n", "artifact A:\n    id is string as {oops}\n    attribute contents is mandatory string\n",
])
def test_bad_metamodels(text):
    with pytest.raises(metamodel.MetamodelError):
        metamodel.parse(text)


def test_id_patterns_of_hyphenated_types():
    import re

    assert re.match(metamodel.id_pattern("{atype}-{num:3}", "SW-REQ"), "SW-REQ-0123")[1] == "0123"
    assert not re.match(metamodel.id_pattern("{atype}-{num:3}", "SW-REQ"), "SW-REQ-12")


def test_edits_in_files():
    text = "x\n[REQ]\nt\n[id] OLD\n[/REQ]\n[REQ]\nu\n```yaml\nattrs:\n  a: 1\n```\n"
    at = text.index("[REQ]\nu")
    assert apply.new_ids(text, [(2, at, "R-1"), (at, len(text), "R-2")]) == "x\n[REQ]\nt\n[id] R-1\n[/REQ]\n[REQ]\nu\n```yaml\nattrs:\n  id: R-2\n  a: 1\n```\n"
    assert apply.new_ids("[< parent = x >>> b >]", [(0, 22, "R-3")]).startswith("[< ID = R-3\n")
    assert apply.set_attribute("[REQ]\nt\n[a] 1\n[/REQ]", "a", "2", "replace") == "[REQ]\nt\n[a] 2\n[/REQ]"
    assert apply.set_attribute("[REQ]\nt\n[a] 1\n[/REQ]", "a", "2", "add") == "[REQ]\nt\n[a] 1\n[/REQ]"
    assert apply.set_attribute("[REQ]\nt\n[a] 1\n[/REQ]", "a", None, "del") == "[REQ]\nt\n[/REQ]"
    assert apply.set_attribute("[REQ]\nt\n[/REQ]", "b", "9", "add") == "[REQ]\nt\n[b] 9\n[/REQ]"
    assert apply.set_attribute("---\nid: x\n---\nb", "s", "1", "add") == "---\nid: x\ns: 1\n---\nb"
    assert apply.marker_ids("a [Note]x[/Note] [NOTE old]", [(2, "NOTE", "7"), (17, "NOTE", "8")]) == "a [Note 7]x[/Note] [NOTE 8]"


def test_graph_limits(spark):
    from threadloom.operators import graph

    chain = [(f"C{i}", f"C{i - 1}") for i in range(1, 23)] + [("D1", "C0"), ("D2", "C0"), ("E", "D1"), ("E", "D2")] + [("X", "Y"), ("Y", "X"), ("Z", "Z")]
    links = spark.createDataFrame(chain, "child_id string, pid string")
    assert {r.start for r in graph.too_deep(links).collect()} == {"C21", "C22", "X", "Y", "Z"}
    pairs = {(r.anc_id, r.desc_id): r.depth for r in graph.closure(links).collect()}
    assert pairs["C0", "E"] == 2 and pairs["C0", "C20"] == 20 and ("C0", "C21") not in pairs and pairs["X", "X"] == 2


def test_tree_lines(spark):
    paths = spark.createDataFrame([("A", "A", 0), ("A/B", "B", 1), ("A/B/D", "D", 2), ("A/C", "C", 1)], "path string, aid string, depth int")
    assert [r.line for r in report.tree(paths).orderBy("path").collect()] == ["A", "├── B", "│   └── D", "└── C"]


def test_stream_upserts_files(spark, tmp_path):
    from threadloom.streaming import incremental

    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    (source / "a.md").write_text("one")
    stream = lambda: incremental.file_stream(spark, str(source)).select("path", "value").writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(incremental.upsert(spark, table)).trigger(availableNow=True).start().awaitTermination(60)
    stream()
    (source / "b.md").write_text("two")
    stream()
    assert sorted(r.value for r in incremental.current(spark, table).collect()) == ["one", "two"]
    (source / "b.md").unlink()
    (source / "c.md").write_text("three")
    (source / "a.md").write_text("one again")
    # a new checkpoint counts its batches from 0 and keeps what the table holds
    again = incremental.file_stream(spark, str(source)).select("path", "value").writeStream.option("checkpointLocation", str(tmp_path / "cp2"))
    again.foreachBatch(incremental.upsert(spark, table)).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.value for r in incremental.current(spark, table).collect()) == ["one again", "three", "two"]


def test_command_line_init_and_schema(tmp_path, capsys):
    from threadloom import cli

    assert cli.main(["--config", str(tmp_path / "c/config.toml"), "init"]) == 0
    assert config.load(tmp_path / "c/config.toml").input[0].marker == "REQ" and metamodel.parse((tmp_path / "c/project.model").read_text())
    assert cli.main(["schema"]) == 0 and '"input"' in capsys.readouterr().out
    for bad in ("", '[[input]]\nname = "a"\ndir = "."\ndriver = "nope"\n', '[[input]]\nname = "a"\ndir = "."\ndriver = "text"\nmarkers = ["x", "X"]\n'):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / "bad.toml")


def test_driver_side_outputs(tmp_path):
    from threadloom.plans import outputs

    assert outputs.ordered_steps("impact")[-1] == "impact" and "validate" not in outputs.ordered_steps("impact")
    with pytest.raises(ValueError):
        outputs.ordered_steps("nope")
    for name in ("a/i.png", "b/i.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = outputs.copy_images([("x", "a/i.png"), ("y", "b/i.png"), ("z", "a/i.png"), ("out", "../secret"), ("gone", "none.png")], tmp_path, tmp_path / "out")
    assert got == {"x": "images/i.png", "y": "images/i-1.png", "z": "images/i.png"} and (tmp_path / "out/images/i-1.png").read_bytes() == b"b/i.png"
    row = {"task_id": "T-1", "atype": "TASK", "child_id": "C", "pid": "P", "child_rev": "1", "parent_rev": "2", "file_name": "T-1.md", "action": "create"}
    assert outputs.write_tasks([row, row | {"action": "skip", "file_name": "no.md"}], tmp_path / "t") == {"create": 1, "update": 0, "skip": 1}
    text = (tmp_path / "t/T-1.md").read_text()
    assert not (tmp_path / "t/no.md").exists() and outputs.check_task(text, text.replace("open", "done")) == [] and outputs.check_task(text, text.replace("id: T-1", "id: T-2")) == ["id was changed"]


def test_attribute_lookup_plans_and_path_matches(spark):
    from pyspark.sql import functions as F

    from threadloom.operators import diff, edit

    value = lambda *v: {"is_list": len(v) > 1, "vals": list(v)}
    rows = spark.createDataFrame([("A", {"Status": value("x"), "tags": value("a", "b"), "blank": value(" ")}), ("B", {})], f"aid string, fields map<string,{model.VALUE}>")
    got = {r.aid: (r.s, r.t, r.b) for r in rows.select("aid", model.attribute_any_case("STATUS").alias("s"), model.attribute_any_case("Tags").alias("t"), model.attribute_any_case("blank").alias("b")).collect()}
    assert got == {"A": ("x", "a, b", None), "B": (None, None, None)}
    plan = lambda op: {(r.aid, r.action) for r in edit.attribute_plan(rows, op, ["Status"], "TBD").collect()}
    assert plan("add") == {("A", "keep"), ("B", "write")} and plan("replace") == {("A", "write"), ("B", "keep")} and plan("del") == {("A", "delete"), ("B", "keep")}
    schemas = spark.createDataFrame([("X-{num}", "R-{num:2}"), ("X-1", "R-{num:2}"), (None, None)], "a string, b string").select(edit.schema_of(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in schemas.collect()] == ["X-{num}", "R-{num:2}", "{atype}-{num:3}"]
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert {tuple(r) for r in diff.match_paths(paths("base/REQ/a.md", "b.md", "x/c.md"), paths("REQ/a.md", "a.md", "b.md", "c.txt")).collect()} == {("base/REQ/a.md", "REQ/a.md"), ("b.md", "b.md")}


def test_edit_commands_end_to_end(spark, home, capsys):
    from threadloom import cli

    conf = str(home / ".tl/config.toml")
    run = lambda *a: cli.main(["--config", conf, "edit", *a])
    assert run("identification") == 2 and run("markers", "renumber") == 2
    before = {p: p.read_bytes() for p in home.rglob("*.md")}
    assert run("identification", "--all", "--dry-run") == 0 and before == {p: p.read_bytes() for p in home.rglob("*.md")}
    out = capsys.readouterr().out
    assert "changed: 2" in out and "files: 2" in out and "SYS-001" in out  # the duplicate is told, not changed
    (home / "REQ/b.md").write_bytes(REQ.replace("\n", "\r\n").encode())
    assert run("identification", "--atype", "REQ") == 0
    text = (home / "REQ/b.md").read_bytes().decode()
    assert "[id] REQ-003" in text and "[id] REQ-001" in text and text.count("\r\n") == text.count("\n") and "[id] REQ-002" in (home / "REQ/2. part/c.md").read_text()
    assert run("identification", "--atype", "REQ", "--force") == 0
    assert "[id] REQ-001" in (home / "REQ/2. part/c.md").read_text() and "[id] REQ-002" in (home / "REQ/b.md").read_text()
    assert run("attrs", "-s", "req", "-n", "owner", "-l", "me") == 0
    text = (home / "REQ/b.md").read_text()
    assert "  owner: me" in text and "[owner] me" in text
    (home / "m.csv").write_text("id;value\nREQ-002;you\n")
    assert run("attrs", "-s", "req", "-o", "replace", "-n", "owner", "--csv", str(home / "m.csv"), "-d", ";") == 0
    assert "modified: 1" in capsys.readouterr().out and "owner: you" in (home / "REQ/b.md").read_text()
    assert run("attrs", "-s", "req", "-o", "del", "-n", "owner") == 0 and "owner" not in (home / "REQ/b.md").read_text()
    assert run("attrs", "-s", "req") == 0 and "[parent] TBD" in (home / "REQ/2. part/c.md").read_text()  # mandatory ones
    assert run("attrs", "-s", "req", "-o", "del") == 3 and run("attrs", "-s", "nope", "-n", "x") == 3
    (home / "REQ/d.md").write_text("[note]one[/note]\n\n[NOTE 4]two[/NOTE]\n\n[Note]three[/Note]\n")
    assert run("markers", "renumber", "--section", "req") == 0
    assert (home / "REQ/d.md").read_text() == "[note 5]one[/note]\n\n[NOTE 4]two[/NOTE]\n\n[Note 6]three[/Note]\n"
    (home / "REQ/bad.md").write_text("[REQ]\nx\n```yaml\nnot: attrs\n```\n")
    assert run("identification", "--all") == 3 and "no attrs" in capsys.readouterr().err


def test_edits_of_other_drivers(spark, tmp_path):
    (tmp_path / "a.py").write_text("# [< ID = S-7 >>> kept >]\n# [< parent = x >>> new >]\n")
    (tmp_path / "f").mkdir()
    (tmp_path / "f/one.md").write_text("---\nid: F-\n---\nbody\n")
    rules = metamodel.parse("artifact SRC:\n    id is string as S-{num}\n    attribute contents is mandatory string\nartifact FRO:\n    id is string as F-{num:2}\n    attribute contents is mandatory string\n")
    inputs = [config.InputRecord("code", ".", "text", filter="*.py", atype="SRC"), config.InputRecord("front", "f", "simple-markdown", atype="FRO")]
    p = project.Project(spark, config.Config(tmp_path, inputs), rules)
    assert p.renumber() == {"changed": 2, "files": 2, "duplicates": []}
    assert (tmp_path / "a.py").read_text() == "# [< ID = S-7 >>> kept >]\n# [< ID = S-8\nparent = x >>> new >]\n" and (tmp_path / "f/one.md").read_text() == "---\nid: F-01\n---\nbody\n"


def test_analysis_with_git_tasks_and_languages(spark, home):
    conf = home / ".tl/config.toml"
    conf.write_text('language = "ru"\n' + conf.read_text() + "[impact]\ntasks_enabled = true\n")
    run = lambda *a, **k: subprocess.run(["git", "-C", str(home), "-c", "user.email=a@b.c", "-c", "user.name=n", *a], check=True, capture_output=True, **k)
    (home / "SYS/a.md").write_text(SYS.replace("The system flies.", "The system flies far."))
    (home / "SYS/z.md").write_text("[ROOT]\n[REQ]\n")
    load = lambda: project.Project.load(spark, conf)
    text = load().analyze(use_git=True)
    assert "ревизии неизвестны" in text and "повторный идентификатор" in text and "нет обязательной трассировки" in text
    run("add", ".")
    run("commit", "-qm", "two", env={"GIT_COMMITTER_DATE": "2037-01-01T00:00:00Z", "PATH": "/usr/bin:/bin"})
    text = load().analyze(use_git=True)
    assert "## Suspicious links (1)" in text and "- REQ-001 -> SYS-001" in text and "[!] OUTDATED" in text and "SYS-001 [*] UPDATED" in text
    assert "Tasks: 1 written, 0 skipped" in text
    task = (home / "tasks/TASK-IMPACT-REQ-001-SYS-001.md").read_text()
    assert "- **ID:** SYS-001" in task and "- **File:** b.md" in task
    facts = files.impact_task(spark.createDataFrame([("t", task)], "path string, value string")).first()
    assert facts.parent["ID"] == "SYS-001" and facts.child["ID"] == "REQ-001" and facts.child["Input Record"] == "req"
    p = load()
    revisions = p.git_revisions()
    assert p.write_tasks(p.stale_links(revisions), revisions) == {"create": 0, "update": 0, "skip": 1}
    told = p.revisions_text("SYS-001")
    assert told[0].endswith("by a@b.c)") and len(told) == 2
    (home / "REQ/b.md").write_text(REQ + "[NOTE n1]twice[/NOTE]\n\n[REQ]\nx\n[id] REQ-9\n[status] active\n[parent] @abc\n")
    p = load()
    p.blocks = p.blocks.withColumn("atype", project.F.when(project.F.col("aid") == "SYS-002", "ROOT").otherwise(project.F.col("atype")))
    assert {"duplicate_block_id", "malformed_reference", "root_count"} <= {r.code for r in p.violations().collect()}


def test_sidecar_revisions(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    (tmp_path / "pic").mkdir()
    (tmp_path / "pic/a.png").write_bytes(b"one")
    (tmp_path / "pic/a.png.stmx").write_text("id: P-1\n")
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "pic/a.png").write_bytes(b"two")
    run("add", ".")
    run("commit", "-qm", "two")
    p = project.Project(spark, config.Config(tmp_path, [config.InputRecord("pic", "pic", "sidecar", atype="PIC")]))
    assert p.git_revisions().filter("aid = 'P-1'").count() == 2


def test_publish_of_several_records_images_and_breaks(spark, tmp_path):
    from threadloom.plans import publish as pub

    (tmp_path / "REQ/1. part").mkdir(parents=True)
    (tmp_path / "img").mkdir()
    (tmp_path / "img/i.png").write_bytes(b"png")
    (tmp_path / "REQ/1. part/2. _CONTENTS_.md").write_text("one\ntwo\n\n![[i.png]]\n")
    (tmp_path / "REQ/b.md").write_text("text\n")
    conf = config.Config(tmp_path, [config.InputRecord("3. req", "REQ", "obsidian", atype="REQ")], strict_line_breaks="off")
    out = project.Project(spark, conf).publish(tmp_path / "out", single=True)[0]
    text = out.read_text()
    assert text.startswith("# req\n\n## part\n\none  \ntwo\n\n![](images/i.png)\n\n## b\n\ntext") and (tmp_path / "out/images/i.png").read_bytes() == b"png"
    assert pub.hard_breaks("a\n```\nb\nc\n```\n- d\ne") == "a  \n```\nb\nc\n```\n- d\ne"


def test_change_files_and_counters(spark, home):
    (home / "REQ/b.md").write_text(REQ.replace("[NOTE n1]mind this[/NOTE]", "[NOTE n1]# now <that>[/NOTE]"))
    p = project.Project.load(spark, home / ".tl/config.toml")
    paths = project.change_files(spark, p.config, p.rules, home, "HEAD", "working", home / "out", "20300101", summary=False)
    head = git.git(home, "rev-parse", "HEAD").strip()[:7]
    assert [x.name for x in paths] == [f"sys-{head}-to-working-20300101.md", f"req-{head}-to-working-20300101.md"]
    text = paths[1].read_text()
    assert "Files: 1 changed, 0 added, 0 removed" in text and "> \\# now <that>" in text and "Files: 0 changed" in paths[0].read_text()
    assert report.change_name("a b/c", "abcdef012", "working", "d", True) == "a-b_c-abcdef0-to-working-d-summary.md"


def test_globs_jpeg_csv_and_conditions(spark, tmp_path):
    import re

    from threadloom.operators import validate
    from threadloom.sources import scan

    match = lambda g, p: bool(re.match(scan.glob_pattern(g), p))
    assert match("*.md", "a/b.md") and match("sub/*.md", "sub/b.md") and not match("sub/*.md", "sub/x/b.md") and match("**/s/?.md", "a/s/b.md") and match("**/*", "a.b") and not match("sub/*.md", "a/sub/b.md")
    for name in ("sub/a.md", "b.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("[REQ]\nx\n[id] R\n")
    p = project.Project(spark, config.Config(tmp_path, []))
    assert [r.path for r in p.record_blocks(config.InputRecord("r", ".", "obsidian", filter="sub/*.md", atype="REQ")).collect()] == ["sub/a.md"]
    jpeg = bytes.fromhex("FFD8FFE000104A46494600010100000100010000FFC0001108") + (33).to_bytes(2) + (44).to_bytes(2) + b"\x03rest"
    frame = spark.createDataFrame([("a.jpg", bytearray(jpeg)), ("b.jpg", bytearray(b"\xff\xd8\xff")), ("c.txt", bytearray(b"x")), ("d", None)], "path string, content binary")
    assert {r.path: (r.width, r.height) for r in files.binary_properties(frame).collect()} == {"a.jpg": (44, 33), "b.jpg": (None, None), "c.txt": (None, None), "d": (None, None)}
    (tmp_path / "m.csv").write_text("\ufeffid,v\nA,\"two\nlines\"\nB,1\nA,last\n", encoding="utf-8")
    assert [(r.id, r.value) for r in files.csv_mapping(spark, str(tmp_path / "m.csv"), "id", "v").orderBy("line_no").collect()] == [("A", "two\nlines"), ("B", "1"), ("A", "last")]
    twice = "- **A:** 1\n- **A:** 2\n- **B:** 3\n"
    assert files.impact_task(spark.createDataFrame([("t", twice)], "path string, value string")).first().fields == {"A": "2", "B": "3"}
    rules = metamodel.parse("artifact A:\n    id is string\n    attribute contents is mandatory string\n    attribute on is optional boolean [true: On, false: off]\n    attribute why is mandatory string if on\n")
    value = lambda v: {"is_list": False, "vals": [v]}
    rows = spark.createDataFrame([(x, "A", "r", {"contents": value("c"), "on": value(x)}) for x in ("On", "ON", " on", "true", "off", "")], f"aid string, atype string, record string, fields map<string,{model.VALUE}>")
    missing = validate.missing_mandatory(rows, rules.frames(spark)[0]).collect()
    assert {r.artifact_id for r in missing} == {"On", "ON"}


def _tree(edges, tops):
    """(depth, aid, line) of a tree by recursion."""
    below = {}
    for c, p in sorted(edges):
        below.setdefault(p, []).append(c)

    def walk(node, bars, mark, depth):
        yield depth, node, bars + mark + node
        kids = below.get(node, []) if depth < 20 else []
        for k in kids:
            more = {"": "", "├── ": "│   ", "└── ": "    "}[mark]
            yield from walk(k, bars + more, "└── " if k == kids[-1] else "├── ", depth + 1)

    return [x for t in sorted(tops) for x in walk(t, "", "", 0)]


def test_first_lines_of_a_tree(spark, monkeypatch):
    import random

    from threadloom.operators import graph

    rng = random.Random(7)
    names = ["A", "A-1", "A/x", "B", "B.2", "Ä", *(f"n{i}" for i in range(14))]
    edges = {(names[j], names[i]) for i in range(len(names)) for j in range(i + 1, len(names)) if rng.random() < 0.16}
    tops = sorted(set(names) - {c for c, _ in edges})
    want = _tree(edges, tops)
    frames = spark.createDataFrame(sorted(edges) * 2, "child_id string, pid string"), spark.createDataFrame([(t,) for t in tops], "aid string")
    for most, counts in ((100_000, (7, 10_000)), (0, (9,))):  # siblings by a window, and by ranges
        monkeypatch.setattr(graph._placed, "__defaults__", (most,))
        for n in counts:
            lines, total = graph.first_lines(*frames, n)
            got = sorted((r.line_no, r.depth, r.aid, r.line) for r in lines.collect())
            assert total == len(want) > 60 and got == [(i, *w) for i, w in enumerate(want[:n])]
    monkeypatch.setattr(graph._placed, "__defaults__", (100_000,))
    # 20 levels of two nodes that share all their children: 2^20 paths and more, of which few are made
    ladder = [(f"L{i + 1:02}{x}", f"L{i:02}{y}") for i in range(20) for x in "ab" for y in "ab"]
    lines, total = graph.first_lines(spark.createDataFrame(ladder, "child_id string, pid string"), spark.createDataFrame([("L00a",), ("L00b",)], "aid string"), 100)
    got = [r.line for r in lines.orderBy("line_no").collect()]
    assert total == 2 * (2**21 - 1) and len(got) == 100 and got[:3] == ["L00a", "├── L01a", "│   ├── L02a"] and got[21].endswith("└── L20b")
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "top")], "child_id string, pid string")
    assert graph.first_lines(ring, spark.createDataFrame([("top",)], "aid string"), 100)[1] == 21


def test_closure_by_doubling_matches_walks(spark):
    import random

    from threadloom.operators import graph

    rng = random.Random(9)
    names = [f"n{i}" for i in range(40)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(45)} | {(f"c{i + 1}", f"c{i}") for i in range(30)}
    for limit in (1, 2, 3, 5, 20):
        want, level = {}, {(p, c) for c, p in edges}
        for depth in range(1, limit + 1):
            for pair in level:
                want.setdefault(pair, depth)
            level = {(a, c) for a, m in level for c, p in edges if p == m}
        got = {(r.anc_id, r.desc_id): r.depth for r in graph.closure(spark.createDataFrame(sorted(edges), "child_id string, pid string"), limit).collect()}
        assert got == want


def _by_line(repo, path):
    """(line, hash) by the long form of blame."""
    out, now = [], None
    for text in git.git(repo, "blame", "--line-porcelain", "HEAD", "--", path).splitlines():
        if text.startswith("\t"):
            out.append((int(now[2]), now[0]))
        elif len(text.split(" ")[0]) == 40:
            now = text.split(" ")
    return out


def test_blame_in_executors(spark, home):
    import random

    rng = random.Random(5)
    run = lambda *a: subprocess.run(["git", "-C", str(home), *a], check=True, capture_output=True)
    lines = [f"line {i}" for i in range(400)]
    for n in range(6):
        for _ in range(25):
            lines[rng.randrange(400)] = f"again {n} {rng.random()}"
        (home / "REQ/long \u00e9.md").write_text("\n".join(lines) + "\n", encoding="utf-8")
        run("add", ".")
        run("commit", "-qm", str(n))
    want = {("REQ/long \u00e9.md", *x) for x in _by_line(home, "REQ/long \u00e9.md")} | {("SYS/a.md", *x) for x in _by_line(home, "SYS/a.md")}
    paths = spark.createDataFrame([("REQ/long \u00e9.md",), ("SYS/a.md",), ("SYS/a.md",), ("SYS/none.md",)], "path string")
    runs = history.blame(spark, home, paths).collect()
    told = [r for r in runs if r.error is None]
    assert {(r.path, n, r.hash_long) for r in told for n in range(r.first, r.last + 1)} == want and len(told) < 400
    assert [(r.path, r.first) for r in runs if r.error] == [("SYS/none.md", None)] and all(r.author_email == "a@b.c" and r.ts for r in told)
    # the interval join: each artifact has the commits of its lines
    spans = [(f"A{i}", ("REQ/long \u00e9.md", a := rng.randint(1, 400), min(400, a + rng.choice([0, 3, 70, 399])))) for i in range(80)]
    frame = spark.createDataFrame(spans, "aid string, loc struct<file:string,line_start:int,line_end:int>")
    got = {(r.aid, r.hash_long) for r in history.revisions(frame, history.blame(spark, home, paths)).collect()}
    assert got == {(aid, h) for aid, (f, a, b) in spans for p, n, h in want if p == f and a <= n <= b}
    # the same as a data source, of a revision or a folder of it
    table = history.blame_table(spark, home)
    assert {(r.path, n, r.hash_long) for r in table.filter("path in ('REQ/long \u00e9.md', 'SYS/a.md')").collect() for n in range(r.first, r.last + 1)} == want
    assert {r.path for r in table.select("path").distinct().collect()} > {"SYS/a.md", "REQ/b.md", ".tl/config.toml"}
    few = history.blame_table(spark, home, "HEAD~6", "SYS").collect()
    assert {r.path for r in few} == {"SYS/a.md"} and {r.hash_long for r in few} == {git.git(home, "rev-parse", "HEAD~6").strip()}


def test_files_that_git_cannot_tell_about_are_violations(spark, home):
    (home / "REQ/new.md").write_text("[REQ]\nNo errors. at all\n[id] REQ-010\n[status] active\n[parent] SYS-001\n", encoding="utf-8")
    text = project.Project.load(spark, home / ".tl/config.toml").analyze(use_git=True, allow_dirty=True)
    assert "revisions are not known: fatal: no such path" in text and "at REQ/new.md" in text and text.errors == 7
    assert project.Project.load(spark, home / ".tl/config.toml").git_revisions().filter("aid = 'REQ-001'").count() == 1


def test_reports_count_what_they_do_not_show(spark, home):
    rules = RULES.replace("SYS-{num:3}", "SYS-{num:3}")
    names = [f"[REQ]\nr{i}\n[id] REQ-{i:03}\n[status] active\n[parent] SYS-001\n\n" for i in range(40, 52)]
    (home / "REQ/many.md").write_text("".join(names), encoding="utf-8")
    subprocess.run(["git", "-C", str(home), "add", "."], check=True)
    subprocess.run(["git", "-C", str(home), "commit", "-qm", "many"], check=True)
    (home / "SYS/a.md").write_text(SYS.replace("The system flies.", "The system flies on."), encoding="utf-8")
    subprocess.run(["git", "-C", str(home), "commit", "-qam", "later"], check=True, env={"GIT_COMMITTER_DATE": "2038-01-01T00:00:00Z", "PATH": "/usr/bin:/bin"})
    text = project.Project.load(spark, home / ".tl/config.toml").analyze(use_git=True, most=5)
    assert "## Suspicious links (13)" in text and "8 more links are not shown." in text and "(9 more lines)" in text and rules == RULES


def test_yaml_booleans_take_the_labels_of_their_attribute(spark, tmp_path):
    rules = metamodel.parse(
        "artifact A:\n    id is string\n    attribute contents is mandatory string\n    attribute active is optional boolean [true: On, yes, false: off]\n    attribute plain is optional boolean\n"
        "    attribute extra is mandatory string if active\n"
    )
    for name, text in {
        "m/a.md": "[A]\nx\n```yaml\nattrs:\n  id: A-1\n  active: true\n  plain: false\n```\n", "f/A-2.md": "---\nactive: false\nplain: true\n---\nbody\n",
        "s/p.png": "x", "s/p.png.stmx": "id: A-3\nactive: yes\ncontents: c\n", "n/n.ipynb": '{"cells": [{"cell_type": "markdown", "source": "[A]\\nx\\n```yaml\\nattrs:\\n  id: A-4\\n  active: false\\n```\\n"}]}',
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    inputs = [config.InputRecord(d, d, driver, atype="A", marker="A") for d, driver in (("m", "obsidian"), ("f", "simple-markdown"), ("s", "sidecar"), ("n", "ipynb"))]
    p = project.Project(spark, config.Config(tmp_path, inputs), rules)
    got = {r.aid: {k: v.vals[0] for k, v in r.fields.items() if k in ("active", "plain")} for r in p.artifacts.collect()}
    assert got == {"A-1": {"active": "On", "plain": "no"}, "A-2": {"active": "off", "plain": "yes"}, "A-3": {"active": "On"}, "A-4": {"active": "off"}}
    assert {(r.code, r.artifact_id) for r in p.violations().collect()} == {("missing_attribute", "A-1"), ("missing_attribute", "A-3")}


def test_rows_before_and_files_of_many_tasks(spark, tmp_path, monkeypatch):
    import csv
    import io

    from threadloom.operators import order
    from threadloom.plans import writer

    rows = [(i % 3 if i % 7 else None, i, f"v{i}") for i in range(500)]
    frame = spark.createDataFrame(rows, "g int, k int, v string").repartition(7)
    last, count, want = {}, {}, {}
    for g, k, v in rows:
        want[k], last[g], count[g] = (last.get(g), count.get(g, 0) + 1), v, count.get(g, 0) + 1
    for small in (order.SMALL, 0):  # in one task, and by ranges
        monkeypatch.setattr(order, "SMALL", small)
        got = {r.k: r.before for r in order.previous(frame, ["g"], ["k"], before=column("v")).collect()}
        numbers = {r.k: r.n for r in order.numbered(frame, ["g"], ["k"], "n").collect()}
        assert {k: (got[k], numbers[k]) for k in got} == want
        whole = {r.k: (r.b, r.n) for r in order.numbered(order.previous(frame, [], ["k"], b=column("v")), [], ["k"], "n").collect()}
        assert whole == {k: (f"v{k - 1}" if k else None, k + 1) for _, k, _ in rows}
    texts = [("a.txt" if i % 5 else "sub/b.txt", i, f"text {i} é" + "x" * (i % 50)) for i in range(3000)]
    files = spark.createDataFrame(texts, "file string, k int, text string").repartition(9)
    out = writer.write_files(files, ["k"], tmp_path / "out", between="\n\n", heads={"a.txt": "head\n", "none.txt": "only a head\n"}, tail="\nend")
    assert [p.relative_to(tmp_path / "out").as_posix() for p in out] == ["a.txt", "none.txt", "sub/b.txt"] and len(list((tmp_path / "out").rglob("*"))) == 4
    for name in ("a.txt", "sub/b.txt"):
        assert (tmp_path / "out" / name).read_text() == ("head\n" if name == "a.txt" else "") + "\n\n".join(t for f, _, t in texts if f == name) + "\nend"
    odd = ["plain", 'quo"te', "a,b", "two\nlines", "cr\rx", "semi;colon", "", None, " space "]
    matrix = spark.createDataFrame([(i + 1, f"L{i}", odd[i % 9], odd[(i * 2) % 9]) for i in range(900)], "record_number long, lead_id string, linked_id string, status string").repartition(5)
    for delimiter in (",", ";", "\t"):
        whole = io.StringIO()
        lines = csv.writer(whole, delimiter=delimiter, lineterminator="\n")
        lines.writerow(["RecordNumber", "ParentID", "ChildID", "status"])
        lines.writerows((i + 1, f"L{i}", odd[i % 9], odd[(i * 2) % 9]) for i in range(900))
        path = report.matrix_file(matrix, tmp_path / "m" / "matrix.csv", False, ["status"], delimiter)
        assert path.read_bytes().decode() == whole.getvalue() == report.matrix_csv(matrix, False, ["status"], delimiter)
    assert report.matrix_file(matrix.limit(0), tmp_path / "m" / "empty.csv", True).read_text() == "RecordNumber,ChildID,ParentID\n"


def test_documents_are_written_by_many_tasks(spark, tmp_path):
    (tmp_path / "REQ").mkdir()
    for i in range(60):
        (tmp_path / "REQ" / f"{i:02}.md").write_text(f"Text {i}.\n\n\n\n# Head\n\n[REQ]\ncontents {i}\n[id] R-{i}\n\nmore text\n", encoding="utf-8")
    p = project.Project(spark, config.Config(tmp_path, [config.InputRecord("req", "REQ", "obsidian", atype="REQ", marker="REQ")]))
    out = p.publish(tmp_path / "out")[0].read_text(encoding="utf-8")
    whole = {r.record: r.document for r in publish.documents(p.pieces()).collect()}
    assert out == whole["req"] and "\n\n\n" not in out and out.count("contents ") == 60 and out.index("Text 9.") < out.index("# R-9") < out.index("Text 10.")
    assert [tuple(r) for r in publish.piece_counts(p.pieces()).collect()] == [("req", 60, 120)]


def test_kept_artifacts_answer_without_parsing(spark, home, monkeypatch, capsys):
    import os
    import random

    from threadloom.plans import kept

    rng = random.Random(11)
    (home / "pic").mkdir()
    (home / "pic/a.png").write_bytes(b"one")
    (home / "pic/a.png.stmx").write_text("id: P-1\ntitle: A Picture of SYSTEMS\n")
    conf = home / ".tl/config.toml"
    conf.write_text(conf.read_text() + '[[input]]\nname = "pic"\ndir = "pic"\ndriver = "sidecar"\natype = "PIC"\n')
    words = ["Fly", "High", "land", "\u00c9t\u00e9", "\u00dfx", "a b", "I\u0307", "%_", "REQ", "tbd"]
    for i in range(12):
        (home / f"REQ/g{i}.md").write_text("".join(f"[REQ]\n{' '.join(rng.choices(words, k=9))}\n[id] G-{rng.randrange(40)}\n[status] active\n\n" for _ in range(5)), encoding="utf-8")
    load = lambda: project.Project.load(spark, conf)
    folder = str(home / "kept")

    def compare(parsed, dropped):
        p = load()
        done = p.keep(folder)
        assert (done["parsed"], done["dropped"]) == (parsed, dropped)
        monkeypatch.setattr(project.Project, "record_blocks", lambda *a: 1 / 0)
        assert p.keep(folder)["parsed"] == 0
        texts = [" ".join(r.vals) for r in load_all.values() for r in r.fields.values() if r.vals] if (load_all := {r.aid: r for r in p.store.occurrences().collect()}) else []
        queries = ["", "f", "hi", "SYS", "req", "none at all", "G-1", "systems"] + [t[(a := rng.randrange(len(t))) : a + n] for n in (1, 3, 4, 7, 12, 25, 40) for t in rng.choices([t for t in texts if t], k=1)]
        got = {q: sorted(r.aid for r in p.search(q).collect()) for q in queries}
        shown = {a: p.content(a) for a in ("REQ-001", "G-3", "P-1", "absent")}
        listed = [tuple(r) for r in p.listing().collect()]
        monkeypatch.undo()
        plain = load()
        assert {q: sorted(r.aid for r in plain.search(q).collect()) for q in queries} == got
        assert {a: plain.content(a) for a in shown} == shown and [tuple(r) for r in plain.listing().collect()] == listed

    compare(16, 0)
    (home / "REQ/g3.md").write_text("[REQ]\nnew words here\n[id] G-3\n\n", encoding="utf-8")
    (home / "REQ/g4.md").unlink()
    (home / "pic/a.png").write_bytes(b"two")
    os.utime(home / "REQ/g5.md")  # touched, not changed
    monkeypatch.setattr(kept, "SEGMENTS", 1)  # all segments are written as one
    seen = kept.SEGMENTS
    compare(2, 1)
    assert seen == 1
    from threadloom import cli

    for args, want in ((["search", "new words", "--store", folder], "G-3 REQ\n"), (["list", "--limit", "1", "--store", folder], "G-0 REQ req\n")):
        capsys.readouterr()
        assert cli.main(["--config", str(conf), *args]) == 0 and capsys.readouterr().out.splitlines(True)[-1].split()[0] == want.split()[0]


def test_trees_read_what_is_asked_for(spark, home):
    from threadloom.sources import trees

    (home / "REQ/bin.dat").write_bytes(bytes(range(256)) * 40_000)
    (home / "REQ/empty.md").write_bytes(b"")
    for args in (("add", "."), ("commit", "-qm", "two")):
        subprocess.run(["git", "-C", str(home), *args], check=True)
    (home / "REQ/b.md").unlink()
    paths = spark.createDataFrame([("b.md",), ("bin.dat",), ("empty.md",), ("2. part/c.md",), ("2. part",), ("none.md",), ("b.md",)], "path string")
    at = lambda end, folder="REQ": trees.tree(spark, home, git.resolve(home, end), folder)
    kept = {r.path: bytes(r.content) for r in at("HEAD").contents(paths).collect()}
    assert set(kept) == {"b.md", "bin.dat", "empty.md", "2. part/c.md"} and kept["bin.dat"] == bytes(range(256)) * 40_000 and kept["empty.md"] == b"" and kept["b.md"].decode() == REQ
    assert {r.path for r in at("HEAD~1").names(paths).collect()} == {"b.md", "2. part/c.md"}
    now = {r.path: r.value for r in at("working").texts(paths.filter("path != 'bin.dat'")).collect()}
    assert now == {"empty.md": "", "2. part/c.md": "[REQ]\nno id\n[status] draft\n"}
    assert {r.path for r in at("HEAD", ".").names(spark.createDataFrame([("SYS/a.md",)], "path string")).collect()} == {"SYS/a.md"}


def test_sources_in_another_encoding_give_nothing(spark, tmp_path):
    (tmp_path / "a.py").write_bytes("# [< ID=A-1 >>> größe >]\n".encode("latin-1"))
    (tmp_path / "b.py").write_bytes("# [< ID=B-1 >>> größe >]\n".encode())
    p = project.Project(spark, config.Config(tmp_path, [config.InputRecord("src", ".", "text", filter="*.py", atype="SRC")]))
    assert {r.aid for r in p.artifacts.collect()} == {"B-1"} and {r.path for r in p.blocks.collect()} == {"b.py"}


def test_sections_of_types_and_markers(spark, home, tmp_path, capsys):
    (home / "pic").mkdir()
    (home / "pic/a b.png").write_bytes(b"png")
    (home / "pic/a b.png.stmx").write_text("id: P-1\ntitle: A plan\n")
    conf = home / ".tl/config.toml"
    conf.write_text(conf.read_text() + '[[input]]\nname = "pic"\ndir = "pic"\ndriver = "sidecar"\natype = "PIC"\n')
    (home / "publish.yaml").write_text(
        "render:\n  req:\n  - {type: text, mode: block, attributes: [{contents: {alias: Text}}]}\n  - {type: text, mode: inline, attributes: [{status: {alias: State}}, {none: {alias: N}}]}\n"
        "  - {type: table, spacer: 2, attribute-presence: all, attributes: [{id: {alias: Key}}, {tag: {alias: Tags}}, {owner: {alias: Owner}}]}\n  Note:\n  - {type: text, mode: inline, alias: Remark}\n"
    )
    p = project.Project.load(spark, conf)
    out = {x.name: x.read_text(encoding="utf-8") for x in p.publish(tmp_path / "o")}
    assert "**Text**\n\nFly high.\n\nVery high, TBD.\n\n**State**: active\n\n&nbsp;\n\n&nbsp;\n\n|  |  |\n| --- | --- |\n| Key | REQ-001 |\n| Tags | a, b |\n| Owner |  |\n" in out["req.md"]
    assert "**Remark**: mind this" in out["req.md"] and "# REQ-001" not in out["req.md"] and "# SYS-001\n\nThe system flies." in out["sys.md"]
    assert "![A plan](images/a b.png)" in out["pic.md"] and (tmp_path / "o/images/a b.png").read_bytes() == b"png" and "| title | A plan |" in out["pic.md"]
    for bad in ("render: {A: [{type: list}]}", "render: {A: [{type: text, mode: block}]}", "render: {A: [{type: table, attributes: [{a: {alias: x}, b: {alias: y}}]}]}", "contents_marker: a/b"):
        (home / "publish.yaml").write_text(bad)
        with pytest.raises(config.ConfigError):
            config.publish_settings(None, None, home)
    import json

    from threadloom import cli

    assert cli.main(["schema", "publish"]) == 0 and "oneOf" in json.loads(capsys.readouterr().out)["properties"]["render"]["additionalProperties"]["items"]
    assert publish.shifted("# 1. One\n```\n# no\n```\n## 2.1 Two", 3, config.Publish()) == "### One\n```\n# no\n```\n#### Two"


def test_check_task_and_picture_sizes(spark, home, capsys):
    from threadloom import cli
    from threadloom.plans import outputs

    text = outputs.TASK.format_map(dict.fromkeys("task_id atype child_rev parent_rev child_id pid parent_type parent_file parent_record child_type child_file child_record".split(), "x"))
    (home / "t.md").write_text(text)
    (home / "pic").mkdir()
    png = lambda w, h: bytes.fromhex("89504E470D0A1A0A0000000D49484452") + w.to_bytes(4) + h.to_bytes(4)
    (home / "pic/a.png").write_bytes(png(3, 4))
    (home / "pic/a.png.stmx").write_text("id: P-1\n")
    for args in (("add", "."), ("commit", "-qm", "two")):
        subprocess.run(["git", "-C", str(home), *args], check=True)
    assert cli.main(["check-task", str(home / "t.md")]) == 0
    (home / "t.md").write_text(text.replace("status: open", "status: closed").replace("child_revision: x", "child_revision: y"))
    assert cli.main(["check-task", str(home / "t.md")]) == 1 and "child revision was changed" in capsys.readouterr().out
    assert cli.main(["check-task", str(home / "none.md")]) == 3
    (home / "pic/a.png").write_bytes(png(30, 40) + b"more")
    conf = config.Config(home, [config.InputRecord("pic", "pic", "sidecar", atype="PIC")])
    report_text = project.changes(spark, conf, metamodel.Metamodel(), home, "HEAD", "working")
    assert "- modified P-1: 24 B `" in report_text and " 3×4 -> 28 B `" in report_text and "30×40" in report_text
