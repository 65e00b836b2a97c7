import time

import random

from pyspark.sql import functions as F

from corpusq.operators import sections as sec

EXCLUDE = (" See also ", " References ", " External links ")


def model(content, exclude=EXCLUDE):
    """An independent reading of the rules, line by line."""
    section = sub = None
    out = []
    for raw in content.split("\n"):
        if raw == "":
            continue
        line = raw.strip()
        if line[:4] == "=== " and line[-4:] == " ===":
            sub = line.strip("=")
        elif line[:3] == "== " and line[-3:] == " ==":
            section = line.strip("=")
        elif section in exclude:
            pass
        elif out and out[-1][:2] == (section, sub):
            out[-1] = (section, sub, out[-1][2] + " " + line)
        else:
            out.append((section, sub, line))
    return out


def parse(spark, contents, **kw):
    pages = spark.createDataFrame(list(enumerate(contents)), "page_id int, content string")
    found = {i: [] for i in range(len(contents))}
    for r in sec.parse_sections(pages, **kw).orderBy("page_id", "section_no").collect():
        assert r["section_no"] == len(found[r["page_id"]])
        found[r["page_id"]].append((r["section"], r["subsection"], r["content"]))
    return [found[i] for i in range(len(contents))]


def test_edge_cases(spark):
    contents = [
        "== A ==\nx\n=== s ===\ny\n== B ==\nz",  # a new section keeps the subsection
        "== A ==\n==== q ====\nb",  # deeper headings are body
        "a\n   \nb",  # a line of spaces adds a space
        "== A ==\n== B ==\nx",  # heading without body
        "== A ==\nx\n== References ==\nr\n== A ==\ny",  # joins again over a left-out section
        "no heading",
        "== ==\nx\n=== ===\ny",
        "",
        "== A ===\nx",
        "  == A ==  \nx",
    ]
    assert parse(spark, contents) == [model(c) for c in contents]


def test_random_pages(spark):
    rnd = random.Random(7)
    lines = ["", " ", "x", "y z", "== A ==", "== B ==", "=== s ===", "=== t ===", "== References ==", "==== d ====", "== See also =="]
    contents = ["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(25))) for _ in range(400)]
    assert parse(spark, contents) == [model(c) for c in contents]
    assert parse(spark, contents, exclude=()) == [model(c, ()) for c in contents]


def test_null_content_gives_no_rows(spark):
    assert sec.parse_sections(spark.createDataFrame([(1, None)], "page_id int, content string")).count() == 0


def test_parsing_moves_no_rows(spark):
    pages = spark.createDataFrame([(1, "x")], "page_id int, content string")
    plan = sec.parse_sections(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


def test_revision_bounds_drop_pages_without_history(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b")], "page_id int, title string")
    revisions = spark.createDataFrame([(1, "2024-01-02"), (1, "2023-05-05")], "page_id int, ts string")
    found = sec.with_revision_times(pages, sec.revision_bounds(revisions)).collect()
    assert [tuple(r) for r in found] == [(1, "a", "2023-05-05", "2024-01-02")]


def test_headings_cost_time_in_proportion(spark):
    def seconds(n):
        lines = [x for i in range(n) for x in (f"{'=' * (2 + i % 3 // 2)} h{i} {'=' * (2 + i % 3 // 2)}", f"body {i}")]
        page = spark.createDataFrame([(1, "\n".join(lines))], "page_id long, content string")
        start = time.perf_counter()
        last = sec.parse_sections(page).orderBy(F.desc("section_no")).first()
        assert last["section_no"] == n - 1 and last["section"].strip(" ") == f"h{max(i for i in range(n) if i % 3 < 2)}"
        return time.perf_counter() - start

    seconds(300)
    assert seconds(64_000) < 20 * max(0.3, seconds(8_000))
