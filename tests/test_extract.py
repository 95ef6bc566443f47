"""Symbols and calls of small sources, one per language."""

import pytest

from weft.extract import extract, extract_calls

CASES = {
    "Rust": (
        "mod shop {\n    pub struct Cart<T> { items: Vec<T>, pub(crate) n: u32 }\n    impl<T: Clone> Cart<T> {\n        pub async fn add(&mut self, x: T) -> Result<(), E> { self.items.push(x); log(\"fn no()\") }\n    }\n    impl fmt::Display for Cart<u8> { fn fmt(&self) {} }\n"
        "    enum State { Open, Closed(u8), Half { a: u8 } }\n    const MAX: usize = 3;\n    static mut N: u8 = 0;\n    type Id = u64;\n}\ntrait Pay { fn pay(&self); fn twice(&self) { fn inner() {} self.pay() } }\nmacro_rules! boom { () => {} }\nunion U { a: u8 }\nfn main() { shop::run::<u8>(1); vec![1]; }\n",
        {"shop:Module", "shop/Cart:Struct", "shop/Cart/items:Field", "shop/Cart/n:Field", "shop/Cart/add:Method", "shop/Cart/fmt:Method", "shop/State:Enum", "shop/State/Open:Variant", "shop/State/Closed:Variant", "shop/State/Half:Variant", "shop/MAX:Const", "shop/N:Const", "shop/Id:TypeAlias", "Pay:Trait", "Pay/pay:Method", "Pay/twice:Method", "Pay/inner:Function", "boom:Macro", "U:Struct", "U/a:Field", "main:Function"},
        {"push", "log", "pay", "run"}, {"no", "vec", "add"},
    ),
    "TypeScript": (
        "export default class Cart {\n  private total: number = 0;\n  static async add(x: number): Promise<void> { this.save(x) }\n  get size() { return 1 }\n}\nabstract class Base { abstract go(): void; }\nnamespace shop { export interface Pay { pay(): void; rate?: number }\n export enum State { Open = 1, Closed }\n export type Id = string | number\n export function run() {} }\nexport const twice = async (x: number): Promise<number> => x * 2;\nconst plain = 5;\nlet f = function () { return g(1) }\n",
        {"Cart:Class", "Cart/total:Field", "Cart/add:Method", "Cart/size:Method", "Base:Class", "Base/go:Method", "shop:Module", "shop/Pay:Interface", "shop/Pay/pay:Method", "shop/Pay/rate:Field", "shop/State:Enum", "shop/State/Open:Variant", "shop/State/Closed:Variant", "shop/Id:TypeAlias", "shop/run:Function", "twice:Function", "f:Function"},
        {"save", "g"}, {"add", "plain"},
    ),
    "Python": ("class A(B):\n    @deco\n    async def go(self):\n        def inner(): pass\n        self.run(x())\n\ndef top(): return A()\n", {"A:Class", "A/go:Method", "A/inner:Function", "top:Function"}, {"run", "x", "A"}, {"go"}),
    "Go": ("package p\n\nimport \"fmt\"\n\ntype Cart struct {\n\tItems []int\n}\ntype Pay interface { Pay() }\ntype Id = int\nconst Rate = 5\nconst (\n\tA, B = 1, 2\n\tC = 3\n)\nfunc (c *Cart) Add(x int) error {\n\tfmt.Println(x)\n\treturn nil\n}\nfunc Run() { helper() }\n", {"Cart:Struct", "Pay:Interface", "Id:TypeAlias", "Rate:Const", "A:Const", "B:Const", "C:Const", "Cart/Add:Method", "Run:Function"}, {"Println", "helper"}, {"Add"}),
    "Java": ("package p;\n@Entity\npublic final class Cart<T> extends Base implements Pay {\n  private static final int A = f(1), b;\n  public Cart(int x) { super(x); }\n  @Override\n  public <R> List<R> add(T x) throws IOException { if (x) { run(new Thing()); } return null; }\n}\nrecord Point(int x) {}\n@interface Mark {}\ninterface Pay { void pay(); }\nenum State { OPEN(1), CLOSED; int n; State(int n) {} void go() {} }\n", {"Cart:Class", "Cart/A:Field", "Cart/b:Field", "Cart/Cart:Method", "Cart/add:Method", "Point:Class", "Mark:Interface", "Pay:Interface", "Pay/pay:Method", "State:Enum", "State/OPEN:Variant", "State/CLOSED:Variant", "State/n:Field", "State/State:Method", "State/go:Method"}, {"f", "run"}, {"Thing", "if", "add"}),
    "C": ("#include <x.h>\n#define MAX(a) \\\n  ((a))\nstruct Cart { int n; char *name; };\nstruct Fwd;\nenum State { OPEN, CLOSED = 2 };\ntypedef unsigned long id_t;\nstatic int *add(struct Cart *c, int x) {\n  if (x) { return run(c); }\n  return 0;\n}\n", {"MAX:Macro", "Cart:Struct", "Cart/n:Field", "Cart/name:Field", "State:Enum", "State/OPEN:Variant", "State/CLOSED:Variant", "id_t:TypeAlias", "add:Function"}, {"run"}, {"if", "add"}),
    "Cpp": ("namespace shop {\nclass Cart : public Base {\n public:\n  int n = 0;\n  void add(int x) { go(x); }\n  int size() const;\n};\nenum class State { Open, Closed };\n}\nint main() { std::vector<int> v; v.push_back(1); }\n", {"shop:Module", "shop/Cart:Class", "shop/Cart/n:Field", "shop/Cart/add:Method", "shop/Cart/size:Method", "shop/State:Enum", "shop/State/Open:Variant", "shop/State/Closed:Variant", "main:Function"}, {"go", "push_back"}, {"add"}),
    "Php": ("<?php\nnamespace Shop;\nabstract class Cart { private ?int $n = 1; const A = 2; public static function add(int $x): int { return $this->run(\\Other\\go($x)); } }\ninterface Pay { public function pay(): void; }\ntrait T {}\nenum S: string { case Open = 'o'; }\nfunction top() { Cart::make(); }\n", {"Shop:Module", "Shop/Cart:Class", "Shop/Cart/n:Field", "Shop/Cart/A:Const", "Shop/Cart/add:Method", "Shop/Pay:Interface", "Shop/Pay/pay:Method", "Shop/T:Trait", "Shop/S:Enum", "Shop/S/Open:Variant", "Shop/top:Function"}, {"run", "go", "make"}, {"add"}),
    "CSharp": ("namespace Shop {\n  [Serializable]\n  public class Cart : Base {\n    private readonly int n, m = 1;\n    public int Total { get; set; }\n    public Cart(int x) : base(x) { }\n    public async Task<int> Add(int x) { int Local(int y) { return y; } return Run(Local(x)); }\n  }\n  record Point(int X);\n  struct P { }\n  interface IPay { void Pay(); }\n  enum State { Open, Closed }\n}\n", {"Shop:Module", "Shop/Cart:Class", "Shop/Cart/n:Field", "Shop/Cart/m:Field", "Shop/Cart/Total:Field", "Shop/Cart/Cart:Method", "Shop/Cart/Add:Method", "Shop/Cart/Local:Method", "Shop/Point:Class", "Shop/P:Struct", "Shop/IPay:Interface", "Shop/IPay/Pay:Method", "Shop/State:Enum", "Shop/State/Open:Variant", "Shop/State/Closed:Variant"}, {"Run", "Local"}, {"Add"}),
    "Swift": ("public final class Cart: Base {\n  var n = 0\n  func add(_ x: Int) -> Int { return run(x) }\n}\nstruct P { let x: Int }\nprotocol Pay { func pay() }\nenum State { case open\n case closed, half }\nlet top = 1\nfunc main() { cart.add(1) }\n", {"Cart:Class", "Cart/n:Field", "Cart/add:Method", "P:Class", "P/x:Field", "Pay:Interface", "Pay/pay:Method", "State:Enum", "State/open:Variant", "State/closed:Variant", "State/half:Variant", "top:Field", "main:Function"}, {"run", "add"}, set()),
    "Kotlin": ("package p\n\ndata class Cart(val x: Int) {\n  val n: Int = 0\n  fun add(x: Int): Int {\n    return run(x)\n  }\n}\nenum class State { OPEN, CLOSED }\nconst val TOP = 1\nfun main() { val c = Cart(1); c.add(2) }\n", {"Cart:Class", "Cart/n:Field", "Cart/add:Method", "State:Class", "State/OPEN:Variant", "State/CLOSED:Variant", "TOP:Const", "main:Function"}, {"run", "add", "Cart"}, {"main"}),
    "Clojure": ("(ns shop.core (:require [x]))\n; (defn no [])\n(def rate 5)\n(defn- add [x] (str/join (run x)))\n(defrecord P [x])\n(defmacro m [] `(do))\n", {"shop.core:Module", "shop.core/rate:Const", "shop.core/add:Function", "shop.core/P:Struct", "shop.core/m:Macro"}, {"join", "run"}, {"defn-", "ns", "no"}),
}


@pytest.mark.parametrize("language", CASES)
def test_symbols(language):
    source, want, _, _ = CASES[language]
    assert {f"{s.name_path}:{s.kind}" for s in extract(language, source)} == want


@pytest.mark.parametrize("language", CASES)
def test_calls(language):
    source, _, want, not_wanted = CASES[language]
    names = {c.name for c in extract_calls(language, source)}
    assert want <= names and not names & not_wanted


def test_places():
    s = {x.name: x for x in extract("Rust", "// é\nimpl A {\n  fn é_b(&self) {\n  }\n}\nfn c() {}\n")}
    assert (s["c"].start_line, s["c"].start_col, s["c"].end_line, s["c"].sel_col) == (6, 0, 6, 3)


@pytest.mark.parametrize("language", [*CASES, "JavaScript"])
@pytest.mark.parametrize("source", ["", "\0", "{{{((", "}}}))", "\"'`/*", "fn (", "class", "(((", "é" * 10, "def f(:\n  pass\nclass A:\n  def g(self): pass\n"])
def test_broken_sources(language, source):
    extract(language, source)
    extract_calls(language, source)


def test_unwired_language():
    assert extract("JavaScript", "function f() {}") == [] and extract_calls("JavaScript", "f()") == []
