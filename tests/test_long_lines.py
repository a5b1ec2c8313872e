"""Minified files: lines of a megabyte."""

import random
import re
import time

from caseloc.operators import code as C

LINES = "path string, line_no int, line string"


def masked(spark, lines):
    rows = C.mask_comments(spark.createDataFrame([("a.js", i + 1, x) for i, x in enumerate(lines)], LINES)).collect()
    return [r.line for r in sorted(rows, key=lambda r: r.line_no)]


def test_comments_of_lines_of_a_megabyte(spark):
    plain, text = "var a=1;" * 130_000, '"' + "\\n'x" * 250_000
    began = time.time()
    got = masked(spark, [plain + "// c", text + '" + 1 // c', text, "/* " * 300_000, "in */ out", "a /* b */ c" * 100_000, "'" * 999_999, "x" * 1_000_000 + " /* open", "still", "*/ end"])
    wanted = [plain, text + '" + 1 ', text, "", " out", "a  c" * 100_000, "'" * 999_999, "x" * 1_000_000 + " ", "", " end"]
    assert [(len(a), a[-9:]) for a in got] == [(len(a), a[-9:]) for a in wanted] and got == wanted
    assert time.time() - began < 120


def test_comments_against_a_scan(spark):
    rng = random.Random(1)
    parts = ['"', "'", "`", "/*", "*/", "//", "\\", "a", " b ", "/", "*"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(10))) for _ in range(2_000)]

    def scan(line):
        out, at = [], 0
        while at < len(line):
            string = re.compile(r"""(["'`])(?:(?!\1)[^\\]|\\.)*\1""").match(line, at)
            if string:
                out.append(string[0])
                at = string.end()
            elif line.startswith("/*", at):
                end = line.find("*/", at + 2)
                if end < 0:
                    return "".join(out)
                at = end + 2
            elif line.startswith("//", at):
                break
            else:
                out.append(line[at])
                at += 1
        return "".join(out)

    rows = [(f"{i}.js", 1, x) for i, x in enumerate(lines)]
    got = {r.path: r.line for r in C.mask_comments(spark.createDataFrame(rows, LINES)).collect()}
    assert all(got[p] == scan(x) for p, _, x in rows)


def test_indent_ends_against_all_later_lines(spark):
    rng = random.Random(2)
    lines = [(f"{f}.py", n + 1, rng.choice(["", "  "]) if rng.random() < 0.2 else " " * rng.randrange(6) + "x") for f in range(30) for n in range(25)]
    solid = [(p, n) for p, n, x in lines if x.strip() and rng.random() < 0.5]
    starts = spark.createDataFrame([(p, "class", f"c{n}", n) for p, n in solid], "path string, kind string, name string, start_line int")
    got = {(r.path, r.start_line): r.end_line for r in C.indent_entities(starts, spark.createDataFrame(lines, LINES)).collect()}
    text = {(p, n): x for p, n, x in lines}
    depth = lambda x: len(x) - len(x.lstrip())
    for p, n in solid:
        later = [m for m in range(n + 1, 26) if text[p, m].strip() and depth(text[p, m]) <= depth(text[p, n])]
        assert got[p, n] == (later[0] - 1 if later else 25)
    assert len(got) == len(solid)
