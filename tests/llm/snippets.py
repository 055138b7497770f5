"""Small texts that parse and that don't, by language."""

VALID = {
 "rust": ["fn f<'a>(x: &'a str) -> &'a str { x }\n", "impl<'a> Foo<'a> for Bar<'a> where T: 'a + Clone {\n    fn g(&self) -> Option<&str> { let v: Vec<_> = (0..n).map(|x| x * 2).collect(); match x { Some(ref y) if *y > 1 => None, _ => Some(\"a\"), } }\n}\n","static X: &'static str = \"a\";\nlet_it!{}\n"],
 "kotlin": ["fun f() {\n    val x = a and b\n    val y = 1 shl 3\n    val m = mapOf(\"a\" to 1, \"b\" to 2)\n    for (i in 0 until n step 2) { println(\"$i\") }\n    x?.let { it!! }\n}\n","data class A(@Body val x: Int, @Inject var y: String = \"\")\n"],
 "csharp": ["foreach (var x in args) {\n    Console.WriteLine(x);\n}\nif (args.Length > 0) return;\n","var q = from x in xs where x.A > 1 orderby x.B descending select new { x.A };\nfor (int i = 0; i < 3; i++) { a[i] = 1; }\n","using System;\nint x = 3;\nx++;\nstring? s = null;\n"],
 "typescript": ["function f(x: unknown): asserts x is string {\n  if (typeof x !== 'string') throw new Error(`a ${b ? `c ${d}` : 'e'} f`);\n}\n","export abstract class A<T extends object = {}> implements B {\n  @Input() name: string;\n  private readonly x?: number;\n  constructor(private a: string) { super(); }\n  get y(): number { return this.x! as number; }\n}\ntype X = keyof typeof obj;\ndeclare module 'x' { export = y; }\n"],
 "javascript": ["const s = `a ${xs.map(x => `<li>${x}</li>\n`).join('')} b`;\nlet {a, ...b} = c ?? {};\nfor await (const x of y) f(x);\nlabel: for (;;) { continue label; }\n", "const html = `<ul>\n${items.map((i) => {\n  return `<li>${i.x}</li>\n`;\n}).join('\\n')}\n</ul>`;\nf(/[/]\"/.test(x));\n"],
 "java": ["module a.b {\n    requires java.sql;\n    exports a.b.c to d.e;\n}\n","package a;\nimport java.util.*;\npublic sealed interface S permits A, B {}\nrecord P(int x, int y) {\n    P { if (x < 0) throw new IllegalArgumentException(\"x\"); }\n    static <T extends Comparable<T>> T max(List<? super T> l) { return l.get(0); }\n    int f(Object o) { return switch (o) { case Integer i when i > 0 -> i; default -> { yield 0; } }; }\n}\n"],
 "php": ["<?php if ($x): ?>\n  <p>it's fine</p>\n<?php endif; ?>\n","<?php\n$a = (int) $x;\n$s = <<<EOT\nit's (a\nEOT;\nfunction f(?int $a = null, string ...$b): ?array { return [...$b, 'x' => fn($y) => $y]; }\n"],
 "ruby": ["s = <<~SQL\n  it's (a \"quote\nSQL\nputs s\n","class A\n  attr_reader :a\n  def f(x) = x + 1\n  def g\n    return unless x =~ /a[(]b/\n    %w[a b].each { |y| puts \"#{y}\" }\n    x = if y then 1 else 2 end\n  end\nend\n"],
 "go": ["package a\n\nimport (\n\tx \"a/b\"\n\t_ \"c\"\n)\n\ntype T struct {\n\tA int `json:\"a\"`\n\tB, C string\n}\n\nfunc (t *T) F(xs ...int) (n int, err error) {\n\tfor i := 0; i < 3; i++ {\n\t\tch <- i\n\t}\n\tswitch v := x.(type) {\n\tcase int:\n\t}\n\treturn\n}\n"],
 "swift": ["import Foundation\n@available(iOS 13, *)\nstruct A: View {\n    @State private var x: Int? = nil\n    var body: some View { Text(\"a \\(x!)\") }\n    func f(_ a: Int, with b: String...) async throws -> [Int] { guard let y = x else { return [] }; return xs.map { $0 + 1 }.reduce(0, +) }\n}\n"],
 "cpp": ["#define F(x, ...) \\\n  g(x, __VA_ARGS__)\ntemplate <typename T, class... A>\nauto f(T&& t, A&&... a) -> decltype(t) { return std::forward<T>(t); }\nstruct B { B(const B&) = delete; B& operator=(B&&) = default; ~B(); bool operator()(int) const; };\nint x = 1'000'000;\nint* p = &x;\n"],
 "c": ["#include <a.h>\nstatic const char *names[] = { \"a\" \"b\", NULL, };\nint main(int argc, char **argv) {\n  for (;;) { x->y++; }\n  return (int) *p;\n}\n"],
 "dart": ["import 'a.dart' show b;\nclass A extends B with C {\n  final int? x;\n  const A({required this.x, super.key});\n  Future<void> f() async { await g(); x++; final s = 'a' 'b'; }\n}\n"],
 "python": ["def f(a, /, b, *, c=1, **d):\n    x = a if b else c\n    match x:\n        case [1, *_]:\n            pass\n    return (yield)\n\nif x: pass\nelse:\n    y = 1.\nclass A: ...\ntype X = int\nwith open(a) as f, \\\n     open(b) as g:\n    print(\"a\" \"b\", file=g)\n"],
 "yaml": ["a: &x\n  b: 1\nc: *x\n","- - 1\n  - 2\n- a: 1\n  b: 2\n","just a scalar\n","a: \"one\n  two\"\nb: 'it''s\n  x'\n","a: one\n  two\nb: 3\n","a:\n- x\n- y:\n    z: 1\n","---\na: |\n  x: [\n\n  y\nb: >-\n  t\n...\n---\n- 1\n","{a: [1,\n 2], b: {c: d}}\n","a: !!str x\nb: !t\n  c: 1\n? k\n: v\n","on:\n  push:\n    branches: [ main ]\njobs:\n  b:\n    steps:\n      - uses: a/b@v1\n        with: {x: 'y: z'}\n      - run: |\n          echo \"a: b\"\n        env:\n          A: ${{ x.y }}\n","a: http://x.y/z#q\nb: a:b\n"],
 "toml": ["a = [\n  1,\n  2, # c\n]\n[[x.y]]\nb = {c = 1, \"d e\" = [1, {f = 2}]}\n\"q.r\".s = 1979-05-27 07:32:00\nt = \"\"\"\na ] \"b\n\"\"\"\nu = '''x'''\n"],
 "xml": ["<?xml version='1.0'?>\n<!DOCTYPE a [\n<!ENTITY b \"c\">\n]>\n<!-- x -->\n<a x='1'\n   y=\"2 > 1\"><b/>t &amp; <![CDATA[ <c> ]]></a>\n"],
 "json": ["[{\"a\": {}, \"b\": [[], [1, -0.5e+3, \"\\u00e9\"]]}, null]\n"],
}
INVALID = {
 "python":["x = = 1\n","def f(a)\n    return 1\n","foo:\n    bar\n","def f():\nreturn 1\n","x = (1\n","if x:\n        a\n    b\n","print 'x'\n","x = \n","a b\n","f(a b)\n","f(a\n  b)\n"],
 "yaml":["a: b: c\n","a: 1\n  b: 2\n","a: [1\n","a:\n    b: 1\n  c: 2\n","\ta: 1\n","a: 'x\n","a: {x, y]\n","a: \"x\" y\n","- a\n b: 1\n"],
 "toml":["a = \n","a b = 1\n","a = 1 2\n","[a\n","a = [1 2]\n","a = [1\n2]\n","a = tru\n","x\n","= 1\n"],
 "xml":["<a><b></a>","<a","<a>x","<a/><b/>","t<a/>","<a x=1/>","<a x='1' x='2'/>","<a>&</a>","<a><!-- x -- y --></a>"],
 "json":["[1,]","{\"a\" 1}","{a:1}","[1 2]","{\"a\":1,}","[","'x'","01","[1]]"],
 "javascript":["f(a b);\n","let x = ;\n","const a = (1 + 2;\n","`abc\n","import logging\n","f(,a)\n"],
 "java":["class A {\n  int f(,int a) {}\n}\n","def f(a):\n    return 1\n"],
 "kotlin":["The scanner reads every file again.\n","fun f() { val x = a b }\n"],
 "csharp":["def f(a):\n    return 1\n","class A { void F( { }\n"],
}
