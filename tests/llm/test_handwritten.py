from tidemark.llm.handwritten import not_handwritten

CODE = "import { base } from './a';\n\nexport function f(items, limit = 3) {\n  return items.filter((x) => x.n > limit);\n}\n"
CODE_PY = "def f(items, limit=3):\n    return [x for x in items if x.n > limit]\n"
FILES = [
    (1, "src/a.js", CODE, None),
    (2, "src/b.js", "// Code generated by x v1.2. DO NOT EDIT.\n" + CODE, "generated"),
    (3, "src/c.js", "// Reads the generated files; edit the templates, not the vendor copy.\n" + CODE, None),
    (4, "src/d.js", CODE + 'export const header = (t) => "// Code generated by " + t + ". DO NOT EDIT.";\n', None),
    (5, "third_party/lib/e.js", CODE + "// five\n", "vendored"),
    (6, "other/copy.js", CODE + "// five\n", "vendored"),
    (7, "vendors/f.js", CODE + "// seven\n", None),
    (8, "src/g.js", "!function(e){" + "var t=e.map(n=>n.x*2);if(t)return t[0];" * 40 + "}();", "minified"),
    (9, "src/h.py", "DATA = (\n" + '    "' + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAx" + '"\n' * 1 + ('    "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAx"\n' * 20) + ")\n", "data"),
    (10, "src/i.rs", "pub static X: [u8; 400] = [\n" + "    0x04, 0x8c, 0x91, 0x60, 0x04, 0x8c, 0x91, 0x60,\n" * 50 + "];\n", "data"),
    (11, "src/j.py", "STEPS = [" + ", ".join(map(str, range(24))) + "]\n\n\ndef f(x):\n    return x\n", None),
    (12, "src/k.py", '"""@generated by tool from x.idl"""\nx = 1\n', "generated"),
    (13, "src/l.rs", "/*\n * Automatisch erzeugt durch tool - bitte nicht von Hand ändern.\n */\nfn f() {}\n", "generated"),
    (14, "static/js/tiny-1.2.3.js", CODE + "//14\n", "vendored"),
    (15, "src/m.ts", None, None),
    (16, "src/n.ts", "", None),
    (17, None, CODE, None),
    (18, "README.md", "// Code generated by x. DO NOT EDIT.", None),
    (19, "src/o.ts", CODE + "// " + "word " * 170 + "\n", None),
    (20, "src/__generated__/p.ts", CODE + "//20\n", "generated"),
    (21, "src/q.js", "/*! lib 1.2 - MIT */\n" + CODE, "vendored"),
    (22, "src/r.js", "/* " + "x " * 100_000 + "*/\n" + CODE, None),
    (23, "src/s.py", "\n".join(f"# shared terms apply to this {i}" for i in range(60)) + "\n#\n# @generated by tool\n\nx = 1\n", "generated"),
    (24, "src/t.js", "// Copyright 2024 the own authors. Licensed under the terms in LICENSE.\n" + CODE, None),
    (25, "other/empty.ts", "", None),
    (26, "src/u.py", CODE_PY + "\n# Generated on 2024-01-01 by tool. Do not modify by hand.\n", "generated"),
    (27, "src/v.js", CODE + "\n/*\n * Fichier généré par tool, ne pas modifier.\n */\n\n", "generated"),
    (28, "src/w.py", CODE_PY + 'HEAD = """\n# Code generated by tool. DO NOT EDIT.\n"""\n', None),
    (29, "src/x.js", "[][(![]+[])[+[]]+(![]+[])[!+[]+!+[]]+\n" * 20 + ("(!![]+[])[+[]]+" * 10 + "\n") * 40, "minified"),
    (30, "src/y.ts", "export const a = '" + "Zm9vYmFy" * 100 + "';\n", "data"),
    (31, "src/z.rs", "fn f(){let x=a;" + "let y=x+b;g(y, x);" * 200 + "}\n", "minified"),
]
EVIDENCE = {2: ["notice"], 5: ["place"], 6: ["copy"], 8: ["layout"], 14: ["place"], 29: ["layout"], 30: ["layout"], 31: ["layout"]}


def test_files(spark):
    df = spark.createDataFrame([(i, "r", p, c, "x", "y") for i, p, c, _ in FILES], "file_id bigint, repo string, path string, content string, reason string, language string")
    got = {r["file_id"]: r["reason"] for r in not_handwritten(df).collect()}
    assert got == {i: r for i, _, _, r in FILES if r}
    spoke = {r["file_id"]: r["evidence"] for r in not_handwritten(df).collect()}
    assert {i: spoke[i] for i in EVIDENCE} == EVIDENCE


def test_each_fetched_row_counts(spark):
    df = spark.createDataFrame([(1, "vendor/a.js", CODE), (1, "vendor/a.js", CODE), (2, "b.js", CODE), (3, "b.js", CODE)], "file_id bigint, path string, content string")
    assert sorted(r["file_id"] for r in not_handwritten(df).collect()) == [1, 1, 2, 3]
    assert not_handwritten(df.limit(0)).count() == 0
