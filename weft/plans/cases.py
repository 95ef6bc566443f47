"""Small sources in every language, one file of each per document, and what an extractor must find in them.

`{n}` stands for the document's id, so names differ between files and the queries run over the whole table.
"""

from __future__ import annotations

SOURCES: dict[str, tuple[str, str]] = {
    "rust": ("rs", """\
mod shop{n} {
    pub struct Cart<T> { items: Vec<T>, pub(crate) n{n}: u32 }
    impl<T: Clone> Cart<T> {
        pub async fn add{n}(&mut self, x: T) -> Result<(), E> {
            self.items.push(x);
            log("fn no()")
        }
    }
    enum State { Open, Closed(u8), Half { a: u8 } }
    const MAX{n}: usize = 3;
    type Id = u64;
}
trait Pay{n} { fn pay(&self); }
macro_rules! boom { () => {} }
fn main{n}() {
    shop::run::<u8>(1);
}
"""),
    "typescript": ("ts", """\
export default class Cart{n} {
  private total: number = 0;
  static async add(x: number): Promise<void> { this.save{n}(x) }
}
interface Pay{n} { pay(): void; rate?: number }
enum State { Open = 1, Closed }
type Id{n} = string | number
export function run{n}() {}
export const twice = async (x: number) => g(x);
"""),
    "tsx": ("tsx", """\
export function App{n}(props) {
  return <Page title="x">{render{n}(props)}</Page>;
}
class View{n} extends Base {
  draw() { return this.paint{n}(1); }
}
"""),
    "python": ("py", """\
class Cart{n}(Base):
    rate = 5

    @deco
    async def add(self, x):
        def inner{n}(): pass
        return self.run{n}(x)


def top{n}():
    return Cart{n}()
"""),
    "go": ("go", """\
package p

type Cart{n} struct {
	Items []int
}
type Pay{n} interface { Pay() }
type Id{n} = int
const Rate{n} = 5
func (c *Cart{n}) Add(x int) error {
	fmt.Println(x)
	return nil
}
func Run{n}() { helper{n}() }
"""),
    "java": ("java", """\
package p;
public final class Cart{n} extends Base {
  private static final int A{n} = f(1), b;
  public Cart{n}(int x) { super(x); }
  public <R> List<R> add{n}(T x) throws IOException {
    return run{n}(x);
  }
}
interface Pay { void pay(); }
enum State{n} { OPEN(1), CLOSED; void go() {} }
"""),
    "c": ("c", """\
#include <x.h>
#define MAX{n}(a) ((a))
struct Cart{n} { int n; char *name; };
enum State{n} { OPEN, CLOSED = 2 };
typedef unsigned long id{n}_t;
static int *add{n}(struct Cart *c, int x) {
  if (x) { return run{n}(c); }
  return 0;
}
"""),
    "cpp": ("cpp", """\
namespace shop{n} {
class Cart{n} : public Base {
 public:
  int n = 0;
  void add(int x) { go{n}(x); }
};
enum class State { Open, Closed };
}
int main{n}() { std::vector<int> v; v.push_back(1); }
"""),
    "php": ("php", """\
<?php
namespace Shop{n};
abstract class Cart{n} {
  private ?int $n = 1;
  const A = 2;
  public static function add{n}(int $x): int { return $this->run{n}($x); }
}
interface Pay { public function pay(): void; }
function top{n}() { Cart::make(); }
"""),
    "csharp": ("cs", """\
namespace Shop{n} {
  public class Cart{n} : Base {
    private readonly int n, m = 1;
    public int Total { get; set; }
    public Cart{n}(int x) : base(x) { }
    public async Task<int> Add(int x) { return Run{n}(x); }
  }
  interface IPay { void Pay(); }
  enum State { Open, Closed }
}
"""),
    "swift": ("swift", """\
public final class Cart{n}: Base {
  var n = 0
  func add{n}(_ x: Int) -> Int { return run{n}(x) }
}
struct P{n} { let x: Int }
protocol Pay { func pay() }
enum State { case open }
"""),
    "kotlin": ("kt", """\
package p

data class Cart{n}(val x: Int) {
  val n: Int = 0
  fun add{n}(x: Int): Int {
    return run{n}(x)
  }
}
enum class State { OPEN, CLOSED }
fun main{n}() { add{n}(2) }
"""),
    "clojure": ("clj", """\
(ns shop{n}.core (:require [x]))
; (defn no [])
(def rate{n} 5)
(defn- add{n} [x]
  (str/join (run{n} x)))
(defrecord P{n} [x])
"""),
}

#: What each source defines and calls, in order: name path (of a call the name alone), kind or `call`, first and last line.
EXPECTED: dict[str, str] = {
    "rust": "shop{n} Module 1 12, shop{n}/Cart Struct 2 2, shop{n}/Cart/items Field 2 2, shop{n}/Cart/n{n} Field 2 2, shop{n}/Cart/add{n} Method 4 7, shop{n}/State Enum 9 9, shop{n}/State/Open Variant 9 9, shop{n}/State/Closed Variant 9 9, shop{n}/State/Half Variant 9 9, shop{n}/MAX{n} Const 10 10, shop{n}/Id TypeAlias 11 11, Pay{n} Trait 13 13, Pay{n}/pay Method 13 13, boom Macro 14 14, main{n} Function 15 17, push call 5 5, log call 6 6, run call 16 16",
    "typescript": "Cart{n} Class 1 4, Cart{n}/total Field 2 2, Cart{n}/add Method 3 3, Pay{n} Interface 5 5, Pay{n}/pay Method 5 5, Pay{n}/rate Field 5 5, State Enum 6 6, State/Open Variant 6 6, State/Closed Variant 6 6, Id{n} TypeAlias 7 7, run{n} Function 8 8, twice Function 9 9, save{n} call 3 3, g call 9 9",
    "tsx": "App{n} Function 1 3, View{n} Class 4 6, View{n}/draw Method 5 5, render{n} call 2 2, paint{n} call 5 5",
    "python": "Cart{n} Class 1 7, Cart{n}/add Method 5 7, Cart{n}/inner{n} Function 6 6, top{n} Function 10 11, run{n} call 7 7, Cart{n} call 11 11",
    "go": "Cart{n} Struct 3 5, Pay{n} Interface 6 6, Id{n} TypeAlias 7 7, Rate{n} Const 8 8, Cart{n}/Add Method 9 12, Run{n} Function 13 13, Println call 10 10, helper{n} call 13 13",
    "java": "Cart{n} Class 2 8, Cart{n}/A{n} Field 3 3, Cart{n}/b Field 3 3, Cart{n}/Cart{n} Method 4 4, Cart{n}/add{n} Method 5 7, Pay Interface 9 9, Pay/pay Method 9 9, State{n} Enum 10 10, State{n}/OPEN Variant 10 10, State{n}/CLOSED Variant 10 10, State{n}/go Method 10 10, f call 3 3, run{n} call 6 6",
    "c": "MAX{n} Macro 2 2, Cart{n} Struct 3 3, Cart{n}/n Field 3 3, Cart{n}/name Field 3 3, State{n} Enum 4 4, State{n}/OPEN Variant 4 4, State{n}/CLOSED Variant 4 4, id{n}_t TypeAlias 5 5, add{n} Function 6 9, run{n} call 7 7",
    "cpp": "shop{n} Module 1 8, shop{n}/Cart{n} Class 2 6, shop{n}/Cart{n}/n Field 4 4, shop{n}/Cart{n}/add Method 5 5, shop{n}/State Enum 7 7, shop{n}/State/Open Variant 7 7, shop{n}/State/Closed Variant 7 7, main{n} Function 9 9, go{n} call 5 5, push_back call 9 9",
    "php": "Shop{n} Module 2 2, Shop{n}/Cart{n} Class 3 7, Shop{n}/Cart{n}/n Field 4 4, Shop{n}/Cart{n}/A Const 5 5, Shop{n}/Cart{n}/add{n} Method 6 6, Shop{n}/Pay Interface 8 8, Shop{n}/Pay/pay Method 8 8, Shop{n}/top{n} Function 9 9, run{n} call 6 6, make call 9 9",
    "csharp": "Shop{n} Module 1 10, Shop{n}/Cart{n} Class 2 7, Shop{n}/Cart{n}/n Field 3 3, Shop{n}/Cart{n}/m Field 3 3, Shop{n}/Cart{n}/Total Field 4 4, Shop{n}/Cart{n}/Cart{n} Method 5 5, Shop{n}/Cart{n}/Add Method 6 6, Shop{n}/IPay Interface 8 8, Shop{n}/IPay/Pay Method 8 8, Shop{n}/State Enum 9 9, Shop{n}/State/Open Variant 9 9, Shop{n}/State/Closed Variant 9 9, Run{n} call 6 6",
    "swift": "Cart{n} Class 1 4, Cart{n}/n Field 2 2, Cart{n}/add{n} Method 3 3, P{n} Class 5 5, P{n}/x Field 5 5, Pay Interface 6 6, Pay/pay Method 6 6, State Enum 7 7, State/open Variant 7 7, run{n} call 3 3",
    "kotlin": "Cart{n} Class 3 8, Cart{n}/n Field 4 4, Cart{n}/add{n} Method 5 7, State Class 9 9, State/OPEN Variant 9 9, State/CLOSED Variant 9 9, main{n} Function 10 10, run{n} call 6 6, add{n} call 10 10",
    "clojure": "shop{n}.core Module 1 1, shop{n}.core/rate{n} Const 3 3, shop{n}.core/add{n} Function 4 5, shop{n}.core/P{n} Struct 6 6, join call 5 5, run{n} call 5 5",
}


def expected(language: str) -> list[tuple[str, str, int, int]]:
    return [(p, k, int(a), int(b)) for p, k, a, b in (x.split(" ") for x in EXPECTED[language].split(", "))]
