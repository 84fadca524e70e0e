"""Source code that misleads line scanners: extents, signatures, callers, confidences, hashes."""

from __future__ import annotations

import pytest

from loomgraph.functions import code, lexing

HARD = {
    "rust": (
        """// fn no() {
/* outer /* fn nested() { */ still */
pub(crate) async fn a<'x>(s: &'x str) -> char { let t = "} fn b() {"; let c = '{'; r#"fn "c" {"#; s.len(); '}' }
mod inner { pub const N: usize = 3; static mut M: i32 = 0; fn d() { super::a("x"); log!("{}", a("y")) } }
pub trait T { fn e(&self); fn f(&self) { self.e() } }
fn g(p: *const u8) -> [u8; 3] { if (true) { return h::<u8>(p); } [0; 3] }
use std::{fmt, io};
""",
        [
            ("function", "p::a", 3, 3, "pub(crate) async fn a<'x>(s: &'x str) -> char"), ("module", "p::inner", 4, 4, "mod inner"), ("constant", "p::inner::N", 4, 4, "pub const N: usize = 3"), ("constant", "p::inner::M", 4, 4, "static mut M: i32 = 0"),
            ("function", "p::inner::d", 4, 4, "fn d()"), ("interface", "p::T", 5, 5, "pub trait T"), ("function", "p::T::e", 5, 5, "fn e(&self)"), ("function", "p::T::f", 5, 5, "fn f(&self)"), ("function", "p::g", 6, 6, "fn g(p: *const u8) -> [u8; 3]"),
        ],
        [("p::a", "len"), ("p::inner::d", "a"), ("p::inner::d", "a"), ("p::T::f", "e"), ("p::g", "h")],
        ["std"],
    ),
    "typescript": (
        """import def, { x } from "./a"; // import y from './z'
import type { Q } from '../q';
export default class Box extends Base {
  private n = `}${ this.lift({ a: 1 }) } {`;
  constructor(private a: number) { super(a); }
  async lift(o: { a: number }): Promise<void> {
    const re = /[{"]/g; return shelve(o) / 2; }
}
export const f = async (x: number): Promise<number> => g(x);
const h = function () { new Box(1).lift({}); };
type U = { a: string };
""",
        [
            ("class", "p::Box", 3, 8, "class Box extends Base"), ("function", "p::Box::constructor", 5, 5, "constructor(private a: number)"), ("function", "p::Box::lift", 6, 7, "async lift(o: { a: number }): Promise<void>"),
            ("function", "p::f", 9, 9, "f = async (x: number): Promise<number> =>"), ("function", "p::h", 10, 10, "h = function ()"), ("type", "p::U", 11, 11, "type U ="),
        ],
        [("p::Box", "lift"), ("p::Box::lift", "shelve"), ("p::f", "g"), ("p::h", "lift")],
        ["./a", "../q"],
    ),
    "ruby": (
        """=begin
class Nope
=end
require_relative('lib/shelf')
class Crane < Base
  NAME = "end class X"
  def lift(x) = x.haul
  def self.sort(items)
    items.each do |i|
      puts "#{weigh(i)} end" if i.heavy?
      while i.left? do i.step end
    end
    text = <<~EOS
      def fake
    EOS
    %w[def end].size / 2
  end
  module Tools; end
end
def last; Crane.sort([]) unless true; end
""",
        [("class", "p::Crane", 5, 19, "class Crane < Base"), ("function", "p::Crane::lift", 7, 7, "def lift(x) = x.haul"), ("function", "p::Crane::sort", 8, 17, "def self.sort(items)"), ("module", "p::Crane::Tools", 18, 18, "module Tools; end"), ("function", "p::last", 20, 20, "def last; Crane.sort([]) unless true; end")],
        [("p::Crane::lift", "haul"), *(("p::Crane::sort", x) for x in ("each", "puts", "weigh", "heavy?", "left?", "step", "size")), ("p::last", "sort")],
        ["lib/shelf"],
    ),
    "python": (
        "import a.b, c\nclass K(Base):\n    '''Doc.'''\n    @deco(1)\n    async def m(self, x: str = \"é)\") -> int:\n        def inner(): return x.y(z())\n        return 1\n",
        [("class", "p::K", 2, 7, "class K(Base):"), ("function", "p::K::m", 5, 7, 'async def m(self, x: str = "é)") -> int:'), ("function", "p::K::m::inner", 6, 6, "def inner():")],
        [("p::K::m::inner", "y"), ("p::K::m::inner", "z"), ("p::K::m", "deco")],
        ["a.b", "c"],
    ),
}


@pytest.mark.parametrize("lang", sorted(HARD))
def test_hard_code(lang):
    source, symbols, calls, imports = HARD[lang]
    rows = code.parse(source, "p", lang)
    found = [r for r in rows if r[0] == "symbol"]
    assert [(r[1], r[3], r[4], r[5], r[7]) for r in found] == symbols
    assert [(r[3], r[6]) for r in rows if r[0] == "call"] == calls and [r[6] for r in rows if r[0] == "import"] == imports
    assert {r[9] for r in rows if r[0] == "call"} == {0.8} and {r[9] for r in rows if r[0] == "import"} == {1.0} and all(r[10] for r in rows if r[0] != "symbol")
    again = {r[3]: r[8] for r in code.parse("\n\n" + source, "p", lang) if r[0] == "symbol"}
    assert {r[3]: r[8] for r in found} == again and len(set(again.values())) == len(again)


@pytest.mark.parametrize("lang", ["rust", "ruby", "typescript"])
def test_blanked_keeps_offsets(lang):
    """Whatever is left open, the text's length and lines stay, and nothing fails."""
    for source in (HARD[lang][0], '"', "'", "/*", "`${", 'r#"', "<<X\n", "=begin", "%w[", "a / b / c", "}}}", ")(", "", "def", "class", "fn", "x(" * 50):
        blank = lexing.blanked(source, lang)
        assert len(blank) == len(source) and [i for i, c in enumerate(blank) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]
        code.parse(source, "m", lang)


def test_no_module():
    assert [r[3] for r in code.parse("def f():\n    pass\n", "", "python")] == ["f"]
