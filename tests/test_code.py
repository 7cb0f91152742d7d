"""Code of several languages is cut before its outermost items, whatever stands in strings and comments."""

import pytest

from skein.operators import chunk as C

SAMPLES = {
    "rust": ('use std::fmt;\n\n/// Shows } and {.\n#[derive(Debug)]\npub struct Ring {\n    c: char,\n}\n\nimpl Ring {\n    fn close(&self) -> bool {\n        self.c == \'}\' || "fn x() {".len() > 1\n    }\n}\n\npub async fn spin<T>(t: T) -> T {\n    t\n}\n', [3, 9, 15]),
    "go": ('package main\n\nimport (\n\t"fmt"\n)\n\ntype Pair struct {\n\ta int\n}\n\n// Sum adds.\nfunc (p Pair) Sum() int {\n\treturn p.a + len(`}\nfunc no() {`)\n}\n\nfunc main() {\n\tfmt.Println("{")\n}\n', [7, 11, 17]),
    "java": ('package a.b;\n\nimport java.util.List;\n\n/** A {@link List}. */\npublic final class Box {\n    char c = \'{\';\n    class Inner {\n    }\n}\n\ninterface Lid {\n    void shut();\n}\n', [5, 12]),
    "kotlin": ('package a\n\ndata class Point(val x: Int)\n\nsuspend fun move(p: Point): Point {\n    val s = """}\n    fun no() {"""\n    return p\n}\n\nobject Origin {\n    val p = Point(0)\n}\n', [3, 5, 11]),
    "swift": ('import Foundation\n\nstruct Cup {\n    var full = true\n}\n\n// Drinks } it.\nfunc drink(_ c: Cup) -> Bool {\n    return c.full\n}\n', [3, 7]),
    "typescript": ("import { a } from './a'\n\nexport interface Shape {\n  side: number\n}\n\nexport async function area(s: Shape) {\n  const text = `{${s.side}`\n  return '}' + text // {\n}\n\nclass Square {\n  grow() {\n    return 1\n  }\n}\n", [3, 7, 12]),
    "svelte": ("<script>\n  import x from 'x'\n\nfunction open() {\n  return '{'\n}\n</script>\n\n<button on:click={open}>Open</button>\n", [1, 4, 8]),
    "python": ("import os\n\n@decorated\ndef f():\n    return '''\ndef no():\n'''\n\nclass K:\n    pass\n", [3, 9]),
}


@pytest.mark.parametrize("language", SAMPLES)
def test_items_of_a_language(language):
    text, starts = SAMPLES[language]
    assert C.code_language(text) == language and C.item_starts(text) == starts
    units = C.code_units(text, 1)
    assert "\n".join(t for t, _, _ in units) == text.rstrip("\n") or "\n".join(t for t, _, _ in units) == text
    assert [a for _, a, _ in units if a in starts] == starts


def test_what_does_not_match_is_cut_by_line_starts():
    text = "fn a() {\n    (\n}\n\nfn b() {\n}\n"
    assert C.braced_starts(text, "rust") is None and C.item_starts(text) == [1, 5]
    assert C.code_language("Nothing of code here.\nOnly prose.") is None
