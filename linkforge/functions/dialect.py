"""The few functions whose spelling differs between SQL dialects.

Scalar functions of this library are SQL text built from these, so that Catalyst sees
built-in expressions only, and so that tests can evaluate the same text elsewhere.
"""

from __future__ import annotations

import re


class Dialect:
    """Spark SQL."""

    name = "spark"

    def lit(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rep(self, x: str, pattern: str, to: str) -> str:
        """All matches replaced; $1 names a group."""
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)})"

    def ext(self, x: str, pattern: str, group: int = 1) -> str:
        """The first match's group, or an empty string."""
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def ext_all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.lit(pattern)})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.lit(pattern)})"

    def filter(self, xs: str, v: str, cond: str) -> str:
        return f"filter({xs}, {v} -> {cond})"

    def map(self, xs: str, v: str, to: str) -> str:
        return f"transform({xs}, {v} -> {to})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def any(self, xs: str, v: str, cond: str) -> str:
        return f"exists({xs}, {v} -> {cond})"

    def has(self, xs: str, x: str) -> str:
        return f"array_contains({xs}, {x})"

    def at(self, xs: str, n: str | int) -> str:
        """Element n from 1, or null."""
        return f"try_element_at({xs}, {n})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_join({xs}, {self.lit(sep)})"

    def cat(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def uniq(self, xs: str) -> str:
        return f"array_distinct({xs})"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def range(self, a: str, b: str) -> str:
        """Whole numbers from a to b; none if b < a."""
        return f"(case when {b} >= {a} then sequence(cast({a} as int), cast({b} as int)) else array() end)"

    def total(self, xs: str) -> str:
        return f"aggregate({xs}, cast(0 as double), (s, x) -> s + x)"

    def find(self, x: str, part: str) -> str:
        return f"instr({x}, {part})"

    def first_char(self, x: str) -> str:
        return f"substring({x}, 1, 1)"


class Duck(Dialect):
    """DuckDB."""

    name = "duckdb"

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def rep(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(re.sub(r'[$](\d)', lambda m: chr(92) + m[1], to))}, 'g')"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self.lit(pattern)})"

    def filter(self, xs: str, v: str, cond: str) -> str:
        return f"list_filter({xs}, lambda {v}: {cond})"

    def map(self, xs: str, v: str, to: str) -> str:
        return f"list_transform({xs}, lambda {v}: {to})"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def any(self, xs: str, v: str, cond: str) -> str:
        return f"(len(list_filter({xs}, lambda {v}: {cond})) > 0)"

    def has(self, xs: str, x: str) -> str:
        return f"list_contains({xs}, {x})"

    def at(self, xs: str, n: str | int) -> str:
        return f"({xs})[{n}]"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def join(self, xs: str, sep: str) -> str:
        return f"array_to_string({xs}, {self.lit(sep)})"

    def cat(self, *xs: str) -> str:
        out = xs[0]
        for x in xs[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def uniq(self, xs: str) -> str:
        return f"list_distinct({xs})"

    def both(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def range(self, a: str, b: str) -> str:
        return f"range({a}, {b} + 1)"

    def total(self, xs: str) -> str:
        return f"coalesce(list_sum({xs}), 0.0)"


SPARK, DUCK = Dialect(), Duck()
