"""Constructs and near misses, one small Go file each."""

import os
import subprocess
import sys

import pytest

from pyspark.sql import functions as F

from seamline.operators.segments import failures
from seamline.plans.occurrences import occurrences

FIELDS = ["variable_name", "command", "method_invoked", "type_passed", "pattern"]
FACTORY, PLAIN_NEW = "factory function", "New() function"


def body(*lines):
    """A file whose function body starts on line 3."""
    return "\n".join(["package p", "func f() {", *lines, "}", ""])


# name -> (text, expected rows of (vector, line, non-blank fields in order))
CASES = {
    # calls by qualified name
    "exec_all": (body('exec.Command("a")', "exec.CommandContext(c)", "syscall.Exec()", "syscall.ForkExec()",
                      "syscall.StartProcess()", "os.StartProcess()", "exec.LookPath()", "os.Exec()"),
                 [("exec", 3, "exec.Command"), ("exec", 4, "exec.CommandContext"), ("exec", 5, "syscall.Exec"),
                  ("exec", 6, "syscall.ForkExec"), ("exec", 7, "syscall.StartProcess"),
                  ("exec", 8, "os.StartProcess")]),
    "exec_not": (body("a.exec.Command()", "exec.Command", "x := `exec.Command(`", '"exec.Command("',
                      "/* exec.Command() */", "// exec.Command()", "(exec).Command()", "f().exec.Command()",
                      "exec.Command[int]()"), []),
    "exec_spread": (body("exec.", "\tCommand()", "exec /* c */ . Command ( )", "exec.// why", "Command()"),
                    [("exec", 3, "exec.Command"), ("exec", 5, "exec.Command"), ("exec", 6, "exec.Command")]),
    "exec_nested": (body('x(exec.Command("a", exec.Command("b")))', "defer exec.Command()"),
                    [("exec", 3, "exec.Command"), ("exec", 3, "exec.Command"), ("exec", 4, "exec.Command")]),
    "plugin": (body('p, err := plugin.Open("x")', "a.plugin.Open()", "plugin.Close()"), [("plugin", 3, "Open")]),
    "unsafe": (body("_ = unsafe.Pointer(uintptr(unsafe.Pointer(&x)))", "unsafe.Sizeof(x)", "var p unsafe.Pointer",
                    "_ = (*int)(unsafe.Pointer(&y))"),
               [("unsafe", 3, "unsafe.Pointer"), ("unsafe", 3, "unsafe.Pointer"), ("unsafe", 6, "unsafe.Pointer")]),
    "cgo": (body("C.free(C.CString(s))", "(*C.char)(p)", "x.C.free()", "C.a.b()"),
            [("cgo", 3, "C.CString"), ("cgo", 3, "C.free")]),
    # init and tests
    "init": ("package p\nfunc init() {}\nfunc (t T) init() {}\nfunc initX() {}\nfunc f() { init() }\n",
             [("init", 2, ""), ("init", 3, "")]),
    "init_spread": ("package p\nfunc (\n\tt T,\n) init() {\n}\n", [("init", 2, "")]),
    "a_test": ("package q\nfunc TestA(t *testing.T) {}\nfunc (s S) BenchmarkB() {}\nfunc ExampleC() {}\n"
               "func FuzzD() {}\nfunc testE() {}\nfunc Helper() { TestA() }\nfunc TestG[T any]() {}\n",
               [("test", 2, "TestA"), ("test", 3, "BenchmarkB"), ("test", 4, "ExampleC"), ("test", 5, "FuzzD"),
                ("test", 8, "TestG")]),
    "not_a_tests": ("package p\nfunc TestA() {}\n", []),
    # directives
    "generate": ("package p\n//go:generate a b\n\t//go:generate  c\n//go:generateX\n// go:generate d\n"
                 "/*\n//go:generate e\n*/\nvar s = `\n//go:generate f\n`\nfunc f() { g() //go:generate h\n}\n"
                 "//go:generate\ti\n//go:generate last",
                 [("generate", 2, "a b"), ("generate", 3, " c"), ("generate", 4, "//go:generateX"),
                  ("generate", 12, "h"), ("generate", 14, "//go:generate\ti"), ("generate", 15, "last")]),
    "generate_crlf": ("package p\r\n//go:generate a\r\n", [("generate", 2, "a")]),
    "line_directive": (body("//line x.y:100", "exec.Command()", "", "exec.Command()", " //line z:7", "exec.Command()",
                            "/*line w:50:3*/exec.Command()"),
                       [("exec", 100, "exec.Command"), ("exec", 102, "exec.Command"), ("exec", 104, "exec.Command"),
                        ("exec", 50, "exec.Command")]),
    "line_text": (body("//line of text", "exec.Command()"), [("exec", 4, "exec.Command")]),
    "line_bad": (body("//line of text: yes", "exec.Command()"), []),
    "line_zero": (body("//line x:0", "exec.Command()"), []),
    "line_tests": ("package p\n//line x:70\nfunc init() {}\n", [("init", 70, "")]),
    # imports
    "import_group": ('package p\nimport (\n"os"\nr "reflect"\n"reflect"\n)\nvar x = "reflect"\n', [("reflect", 4, "")]),
    "import_single": ('package p\nimport "reflect"\nimport r "reflect"\nimport . "reflect"\nimport _ "reflect"\n',
                      [("reflect", 2, ""), ("reflect", 3, ""), ("reflect", 4, ""), ("reflect", 5, "")]),
    "import_not": ("package p\nimport `reflect`\nimport \"reflect/x\"\nfunc f() { g(\"reflect\") }\n", []),
    # constructors
    "new": (body("a.NewFoo()", "New()", "NewFoo()", "b.c.New()", "x.NewFoo[int]()", "newFoo()", "a.Newer().NewX()",
                 "return New (1)", "T{}.NewA()", "go a.NewB()"),
            [("constructor", 3, "NewFoo", FACTORY), ("constructor", 4, "New", PLAIN_NEW),
             ("constructor", 6, "New", FACTORY), ("constructor", 9, "NewX", FACTORY),
             ("constructor", 9, "Newer", FACTORY), ("constructor", 10, "New", PLAIN_NEW),
             ("constructor", 11, "NewA", FACTORY), ("constructor", 12, "NewB", FACTORY)]),
    "new_declared": ("package p\nfunc New() {}\nfunc (t T) New() {}\nfunc New[T any]() {}\n"
                     "type I interface {\n\tNew() int\n\tA(f func()) B\n\tNew(x interface{ New() })\n}\n"
                     "type J interface{ New() }\nfunc f() {\n\tNew()\n\tg()\n\tNew()\n\tvar _ interface {\n"
                     "\t\tNew()\n\t}\n}\n",
                     [("constructor", 12, "New", PLAIN_NEW), ("constructor", 14, "New", PLAIN_NEW)]),
    "new_after_paren": (body("g()", "New()", "if (x) { New() }"),
                        [("constructor", 4, "New", PLAIN_NEW), ("constructor", 5, "New", PLAIN_NEW)]),
    "chain_lines": (body("foo.", "\tBar(", "\t\t1).", "\tNewX().", "\tNewY()", "y := &T{", "}.", "NewZ()",
                         "[]byte(", "x).NewW()", "(a).", "NewV()", "m[", "0].NewU()", "func() T {", "}().NewS()",
                         "map[string]T{", "}.NewR()", "x.(", "T).NewQ()", '"a".', "NewP()"),
                    [("constructor", 3, "NewX", FACTORY), ("constructor", 3, "NewY", FACTORY),
                     ("constructor", 8, "NewZ", FACTORY), ("constructor", 11, "NewW", FACTORY),
                     ("constructor", 13, "NewV", FACTORY), ("constructor", 15, "NewU", FACTORY),
                     ("constructor", 17, "NewS", FACTORY), ("constructor", 19, "NewR", FACTORY),
                     ("constructor", 21, "NewQ", FACTORY), ("constructor", 23, "NewP", FACTORY)]),
    # methods of the same file
    "interface": ("package p\nfunc (t T) Run() {}\nfunc Go() {}\nfunc f(t T, u U) {\n\tt.Run()\n\tu.v.Run()\n"
                  "\tu.Stop()\n\tt.Go()\n\tf(\n\t1).Run()\n\tRun()\n\tt.Run\n}\n",
                  [("interface", 5, "Run", "t"), ("interface", 6, "Run"), ("interface", 9, "Run")]),
    "interface_generic": ("package p\nfunc (t *T[K]) Run() {}\nfunc f() { x.Run() }\n", [("interface", 3, "Run", "x")]),
    "interface_none": ("package p\nfunc f() { x.Run() }\nfunc Run() {}\n", []),
    # initialisers
    "global": ("package p\nvar a = f()\nvar b, c = g(1, 2), h()\nvar d = x.y.Z(1).W()\nconst K = time.Duration(5)\n"
               "var e = func() (int, error) {\n\treturn g()\n}()\nvar i T = T(3)\nvar j map[string]func() = m()\n"
               "var k =\n\tq()\nvar l = [3]T{}.M()\nvar n = func() T { return t }().Sel()\nvar o = s[0](1).P()\n",
               [("global", 2, "a f()"), ("global", 3, "b g()"), ("global", 4, "d W()"), ("global", 5, "K Duration()"),
                ("global", 6, "e anonym func"), ("global", 9, "i T()"), ("global", 10, "j m()"), ("global", 12, "k q()"),
                ("global", 13, "l M()"), ("global", 14, "n Sel()"), ("global", 15, "o P()")]),
    "global_not": ("package p\nvar a = f() + 1\nvar b = f()()\nvar c = (f)()\nvar d = []byte(\"z\")\nvar e = f[int]()\n"
                   "var g = &T{}\nvar h, i = 1, f()\nvar j = -f()\nvar k = func() { f() }\nvar l int\nvar m = T{f()}\n"
                   "var n = 1 + f()\nvar o = *p.q()\nvar r = <-c()\nvar s = !t()\nvar u = x.f\nvar v = &T{}.F()\n"
                   "var w = map[string]int{\"a\": f()}\nvar y = x.(T)\nvar z = f() == g()\n", []),
    "global_group": ("package p\nvar (\n\ta = f()\n\tb = 1\n\tc = func() int {\n\t\tx := y()\n\t\treturn x\n\t}()\n"
                     "\td, e = x.F(), 2\n\tg T\n\th = f() +\n\t\t1\n)\nconst (\n\tk = iota\n\tl\n\tm = C(1)\n)\n"
                     "func f() { var z = f() }\nvar (n = f(); o = g())\nvar q = f()",
                     [("global", 3, "a f()"), ("global", 5, "c anonym func"), ("global", 9, "d F()"),
                      ("global", 17, "m C()"), ("global", 20, "n f()"), ("global", 20, "o g()"),
                      ("global", 21, "q f()")]),
    "global_types": ("package p\nvar a = func() interface{} { return 1 }()\nvar b = func() map[string]struct{} {\n"
                     "\treturn nil\n}()\nvar c = struct{}{}.M()\nvar d = func() func() int { return f }()\n"
                     "var e = [2]struct{}{}\nvar g chan<- int = f()\nvar h =x.\n\ty()\n",
                     [("global", 2, "a anonym func"), ("global", 3, "b anonym func"), ("global", 6, "c M()"),
                      ("global", 7, "d anonym func"), ("global", 9, "g f()"), ("global", 10, "h y()")]),
    # lexing
    "quotes": (body("x := '\"'", "exec.Command(`a", "b(`, \"\\\"(\", '\\'', '(')", "exec.Command()"),
               [("exec", 4, "exec.Command"), ("exec", 6, "exec.Command")]),
    "unicode": (body("ü.Newä()", "世界.New界()"), [("constructor", 3, "Newä", FACTORY), ("constructor", 4, "New界", FACTORY)]),
    "comment_lines": (body("/* a", "b */ exec.Command() /* c", "*/", "exec.Command()"),
                      [("exec", 4, "exec.Command"), ("exec", 6, "exec.Command")]),
    "bom": ("﻿package p\nfunc init() {}\n", [("init", 2, "")]),
    # ill-formed files give nothing
    "bad_open": ("package p\nfunc init() {\n", []),
    "bad_close": ("package p\nfunc init() {}}\n", []),
    "bad_kinds": ("package p\nfunc init() {(]}\n", []),
    "bad_string": (body('x := "abc', "exec.Command()"), []),
    "bad_rune": (body("x := 'ab'", "exec.Command()"), []),
    "bad_comment": ("package p\nfunc init() {}\n/* open\n", []),
    "bad_package": ("func init() {}\n", []),
    "bad_statement": ("package p\nfunc init() {}\nx := 1\n", []),
    "bad_character": ("package p\nfunc init() { a # b }\n", []),
    "bad_bom": ("package p\nfunc init() {}\n// ﻿\n", []),
    "bad_nul": ("package p\nfunc init() {}\n// \0\n", []),
}


@pytest.fixture(scope="module")
def found(files_of):
    files = files_of({f"m/{name}/{name}.go": text for name, (text, _) in CASES.items()}
                     | {f"m/{name}/z.go": "package z\n" for name in CASES})
    rows = {name: [] for name in CASES}
    for r in occurrences(files).collect():
        name = r.file_path.split("/")[1]
        rows[name].append((r.vector, r.line_number, *[r[f] for f in FIELDS if r[f]]))
    return rows


def flat(rows):
    return sorted((v, line, " ".join(x for x in rest if x)) for v, line, *rest in rows)


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    vectors = {e[0] for e in CASES[name][1]} | {name.split("_")[0]}
    focus = {"new": {"constructor"}, "chain": {"constructor"}, "a": {"test"}, "not": {"test"}, "unicode": {"constructor"},
             "line": {"exec", "init"}, "import": {"reflect"}, "quotes": {"exec"}, "comment": {"exec"}, "bom": {"init"},
             "bad": {"init", "exec"}}
    vectors |= focus.get(name.split("_")[0], set())
    got = [row for row in found[name] if row[0] in vectors]
    assert flat(got) == flat(CASES[name][1])


def test_package_names(files_of):
    files = files_of({
        "m/a/b.go": "// this package provides things\npackage other\nfunc init() {}\nvar x = func() int { return 1 }()\n",
        "m/a/c_test.go": "package other_test\nfunc TestX() {}\n",
        "m/none/x.go": "func init() {}\n",
        "m/none/_y.txt": "package q\n",
        "m/up/A.go": "// nothing here\n",
        "m/up/z.go": "package late\nfunc init() {}\n"})
    rows = {(r.vector, r.package_name, r.file_path) for r in occurrences(files).collect()}
    assert rows == {
        ("init", "provides", "m/a/b.go"), ("global", "", "m/a/b.go"),
        ("test", "provides", "m/a/c_test.go/other_test"), ("init", "late", "m/up/z.go")}


def test_assembly(files_of):
    go = ("package p\nfunc asmFn(x int)\nfunc f() {\n\tasmFn(1)\n\tsecond()\n\tx.asmFn()\n\tt.u(asmFn(2))\n}\n"
          "func (t T) asmFn() {}\ntype I interface {\n\tasmFn()\n}\n")
    text = "TEXT\t·asmFn(SB)\nTEXT ·second(SB)\n"
    files = files_of({
        "m/a/a.go": go, "m/a/x.s": text, "m/a/y.S": text.replace("asmFn", "_hidden"), "m/a/n.sx": "TEXT p·f(SB)",
        "m/b/b.go": go, "m/b/asm.s.txt": text})
    rows = [(r.file_path, r.line_number, r.method_invoked) for r in occurrences(files, ["assembly"]).collect()]
    assert sorted(rows) == [
        ("m/a/a.go", 4, "asmFn"), ("m/a/a.go", 5, "second"), ("m/a/a.go", 7, "asmFn")]


def test_assembly_without_broadcast(spark, files_of):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    go = "package p\nfunc f() {\n\tasmFn(1)\n}\ntype I interface {\n\tasmFn()\n}\n"
    files = files_of({"m/a/a.go": go, "m/a/x.s": "TEXT ·asmFn(SB)\n", "m/b/b.go": go})
    try:
        rows = occurrences(files, ["assembly", "init"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.file_path, r.line_number) for r in rows] == [("m/a/a.go", 3)]


def test_statement_after_a_number_that_ends_in_a_dot(files_of):
    text = ("package p\nvar a = 3.\nfunc init() {}\nconst A = 1_0.\nvar b = f()\nvar (\n\tx = 1.\n\ty = f()\n\tz = g.h()\n)\n"
            "var w = x1.\n\tF()\n")
    rows = sorted((r.vector, r.line_number, r.variable_name) for r in occurrences(files_of({"m/a/a.go": text}), ["init", "global"]).collect())
    assert rows == [("global", 5, "b"), ("global", 8, "y"), ("global", 9, "z"), ("global", 11, "w"), ("init", 3, "")]


def test_conversions_to_type_literals_are_no_calls(files_of):
    text = ("package p\nvar a = interface{}(y)\nvar b = interface{ M() }(y)\nvar c = struct{ A int }(y)\n"
            "var d = T(y)\nvar e = interface{}(y).F()\n")
    rows = [(r.variable_name, r.method_invoked) for r in occurrences(files_of({"m/a/a.go": text}), ["global"]).collect()]
    assert sorted(rows) == [("d", "T()"), ("e", "F()")]


ILL_FORMED = [
    "func init() { x := := 3 }", "func init() { x = = 3 }", "func f() {}\nimport \"fmt\"\nfunc init() {}", "var x\nfunc init() {}",
    "const x, y\nfunc init() {}", "func init() { x[(]) }", "func init() { f(} ){ }",
    # brackets of two kinds that swap their ends
    "func init() { a = (b] ; c = [d) }", "func init( { }\n)", "func init() { a[(b] + c[d)] }",
    # tokens that cannot follow each other
    "func init() { x = }", "func init() { if a {} else else {} }", "func init() { f(, a) }", "func init() { f(a b.) }",
    "func init() { x := 3 y }", 'func init() { x := "a" "b" }', "func init() { if {} }", "func init() { a + / b }", "func init() { a, = f() }",
    "func init() { return if a {} }", "func init() { x if y {} }", "func init() { if a {}\nelse {} }", "func init() { x; else {} }",
    "func init() { map { } }", "func init() { f(a, , b) }", "func init() { f({1}) }", "func init() { a[{1}] }", "func init() { goto 3 }",
    "func init() { struct x }", "func init() { for for {} }", "func init() { go }", "func init() { f(return) }", "func init() { x = ; }",
    "func init() { (* b) = && c }", "func init() { break = 3 }", "func init() { f(!) }", "func init() { if x { } else y() }",
    "func init() { switch x { default x } }", "func init() { defer }"]

WELL_FORMED = [
    'import "fmt"\nfunc init() { fmt.Println() }', 'import "fmt"\nvar x = 1\nfunc init() {}', 'import f "fmt"\nimport . "os"\nimport _ "io"\nfunc init() {}',
    "func init() { x++; y--; a[i]++\n}", "func init() { for { } }", "func init() { for range ch {}; for k := range m {}; for i := range 3 {} }",
    "func init() { if a := f(); a > 3 && !b { } else if c { } else { } }", "func init() { switch { case a: return; default: } }",
    "func init() { switch x := y.(type) { case int, *T: break; case func(): fallthrough\ncase map[string]int, chan<- int, <-chan int: } }",
    "func init() { select { case v, ok := <-c: _ = v; case c <- 1: default: } }", "func init() { go func() {}(); defer func() {}() }",
    "func init() { return }", "func init() { L: for { break L; continue L }; goto L }", "func f[T ~int | ~string, U any](x ...T) (a, b U) { return }\nfunc init() {}",
    "type I interface { ~[]int | *T; M(); fmt.Stringer }\nfunc init() {}", 'type S struct { A int `json:"a"`; B, C string "x"; *T; D struct{} }\nfunc init() {}',
    "func init() { x := []int{1, 2, 3,}; y := [...]int{1: 2}; z := a[:]; w := a[1:]; v := a[:2:3]; f(x...) }",
    "func init() { m := map[string][]struct{ a int }{\"k\": {{1}, {2}}}; p := &T{}; q := *p; r := -x; s := ^y; t := <-c; u := !v }",
    "func init() { x &^= 3; x <<= 1; x |= 2; x %= 3; a, b = b, a; x = *p * *q; y := a - -b; z := a & ^b }",
    "func init() { a := 1.; b := .5; c := 0x1p-2; d := 'x'; e := 1i; f := \"s\"[0]; g := (1) }", "func init() {\n\tx :=\n\t\t3 +\n\t\t4\n\tf(\n\t\ta,\n\t)\n}",
    "func (t *T) init() { t.\n\tA().\n\tB() }\nfunc init() {}", "var (\n\ta = 3\n\tb, c = f()\n)\nconst (\n\tx = iota\n\ty\n)\nfunc init() {}",
    "func init() { var x interface{} = nil; var f func(int) (int, error); var c chan struct{}; type local struct{} }",
    "func init() { if x == (T{1}) { } ; if f(func() {}) { } ; for i := 0; i < 3; i++ { } ; for ; ; { } }",
    "func f(func(), ...int) func() int\nfunc init() { func() {}(); _ = func() int { return 1 }() }", "func init() { ; }", "func init() { {}; {} }",
    "type A = B\ntype G[K comparable, V any] struct { m map[K]V }\nfunc (g *G[K, V]) Get() V { return g.m[*new(K)] }\nfunc init() { x := G[int, string]{} }",
    "func init() {\n\tif a {\n\t} else /* c */ {\n\t}\n\tx := 3 // note\n\ty := \"s\" // note\n\treturn\n}",
    "func init() {\n//line x.go:5\n\tif a {}\n\tf()\n//line y.go:7\n\tif b {}\n}", "type T struct {\n\tx /*line a.go:1*/ struct /*line a.go:2*/ {}\n}\nfunc init() {}",
    "func init() { ifx := elsey; returns, ok := gotox.structs; mapped(ok) }", "func init() { 世界 := é.ä; _ = 世界 }",
    "func init() { x = `a\nb`\n\tif y { } }", "func init() { a := b[i](c)[d].e(f){}.g }", "func init() { print(1, 2, -3, +4, &x, <-y, !z, ^w) }",
]


def test_well_and_ill_formed(files_of):
    """All in one pass; each file is a module of its own."""
    texts = {f"{kind}{i}/a/a.go": f"package p\n{text}\n" for kind, list_ in (("good", WELL_FORMED), ("bad", ILL_FORMED)) for i, text in enumerate(list_)}
    files = files_of(texts)
    bad = {r.path: r.reason for r in failures(files).collect()}
    assert bad == {path: "ill-formed" for path in texts if path.startswith("bad")}
    assert {r.file_path for r in occurrences(files, ["init"]).collect()} == {path for path in texts if path.startswith("good")}


def test_a_directive_before_a_declaration(files_of):
    texts = {
        "a": "package a\n/*line q.go:50*/func init() {}\n", "b": "package a\n/*line q.go:50:1*/func init() {}\n",
        "c": "package a\n/*line q.go:50*/var b = f()\n", "d": "package a\nvar x = f(1)\n/*line q.go:50*/func init() {}\nfunc init() {}\n",
        "e": "package a\nfunc g() {}\n/*line q.go:20*/ /*line r.go:50*/func init() {}\n",
        "f": "package a\nvar x = a +\n/*line q.go:50*/f()\nvar y = f()\n", "g": "package a\n/*line q.go:50*/import \"reflect\"\nfunc init() {}\n",
        "h": "package a\nfunc g() {\n\tf(1)\n/*line q.go:50*/New()\n}\n"}
    rows = occurrences(files_of({f"m/{k}/{k}.go": t for k, t in texts.items()})).collect()
    got = sorted((r.file_path[2], r.vector, r.line_number, r.variable_name) for r in rows)
    assert got == [("a", "init", 50, ""), ("b", "init", 50, ""), ("c", "global", 50, "b"), ("d", "global", 2, "x"), ("d", "init", 50, ""),
                   ("d", "init", 51, ""), ("e", "init", 50, ""), ("f", "global", 51, "y"), ("g", "init", 51, ""), ("g", "reflect", 50, ""),
                   ("h", "constructor", 50, "")]


def test_deep_nesting(files_of):
    from seamline.operators import segments
    deep = "package p\nfunc init() { x = " + "(" * 20_000 + "y" + ")" * 20_000 + " }\n"
    files = files_of({"m/a/a.go": deep, "m/a/b.go": deep.replace("y)", "y]")})
    assert [r.path for r in failures(files).collect()] == ["m/a/b.go"] and segments.MAX_NESTING == 100_000


def test_tokens_of_equal_paths(spark, files_of):
    from seamline.operators.tokens import tokens
    text = "package p\n\n\nvar x\n"
    files = files_of({"m/a.go": text, "n/a.go": text}).withColumn("path", F.lit("a.go"))
    rows = tokens(files, 1).collect()
    assert sorted((r.module, r.tok, r.line) for r in rows) == sorted(
        (m, t, line) for m in "mn" for t, line in (("package", 1), ("p", 1), ("var", 4), ("x", 4)))


def test_equal_paths_in_two_modules(files_of):
    good, bad = "package p\nfunc init() {}\n", "package p\nfunc init() {\n"
    files = files_of({"m/a.go": good, "n/a.go": good, "o/a.go": bad}).withColumn("path", F.lit("a.go"))
    assert sorted(r.module for r in occurrences(files, ["init"]).collect()) == ["m", "n"]


def test_single_vectors_agree_with_one_pass(files_of):
    from seamline import schema
    files = files_of({f"m/{n}/{n}.go": t for n, (t, _) in CASES.items()})
    together = sorted(map(tuple, occurrences(files).collect()))
    alone = sorted(tuple(r) for v in schema.VECTOR_NAMES for r in occurrences(files, [v]).collect())
    assert alone == together


def test_long_text_needs_no_deep_stack(files_of):
    long = "x" * 500_000
    text = (f'package p\n/* {long}\n*/\nvar s = "{long}"\n' + "// line\n" * 50_000
            + "var t = a" + " + b" * 100_000 + "\nfunc init() {}\nvar u = " + "f(" * 3000 + ")" * 3000 + "\n")
    rows = {(r.vector, r.line_number, r.variable_name) for r in occurrences(files_of({"m/a/a.go": text})).collect()}
    assert rows == {("init", 50_006, ""), ("global", 50_007, "u")}


def test_long_specifications(files_of):
    text = ("package p\nvar a = " + " + ".join(["f(1)"] * 30_000) + "\nvar b, c = f(), " + ", ".join(["g(1)"] * 30_000)
            + "\nvar d = x" + ".y(1)" * 3000 + ".last()\nvar e = h(1) - " + " * ".join(["g()"] * 2000) + "\n")
    rows = {(r.line_number, r.variable_name, r.method_invoked)
            for r in occurrences(files_of({"m/a/a.go": text}), ["global"]).collect()}
    assert rows == {(3, "b", "f()"), (4, "d", "last()")}


def test_checkpoint_folder(tmp_path):
    """Where the session names a checkpoint folder, results are settled there."""
    script = f"""
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "{tmp_path}").getOrCreate())
from seamline.operators.bounds import settle
df = settle(spark.range(10))
assert df.count() == 10 and "LogicalRDD" in df._jdf.queryExecution().optimizedPlan().toString()
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120)
    assert done.returncode == 0 and list(tmp_path.rglob("*part-00000*"))
