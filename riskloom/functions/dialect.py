"""Two spellings of the same SQL: Spark's, which runs, and DuckDB's, which the results are held against."""

from __future__ import annotations


class Spark:
    idiv, st, g, rowfn, size, list_of = "div", "struct", "", "struct", "size", "collect_list"

    @staticmethod
    def days(end: str, start: str) -> str:
        return f"datediff({end}, {start})"

    @staticmethod
    def hash32(text: str) -> str:
        return f"cast(conv(substr(md5(cast({text} as binary)), 1, 8), 16, 10) as bigint)"

    @staticmethod
    def each(array: str, name: str) -> str:
        return f"lateral view explode({array}) {name}_t as {name}"

    @staticmethod
    def each_at(array: str, name: str, pos: str) -> str:
        return f"lateral view posexplode({array}) {name}_t as {pos}, {name}"

    @staticmethod
    def split(text: str, sep: str) -> str:
        return f"split({text}, '{sep}')"

    @staticmethod
    def split_re(text: str, pattern: str) -> str:
        return f"split({text}, r'{pattern}')"

    @staticmethod
    def found(text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, r'{pattern}', {group})"

    @staticmethod
    def first(text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, r'{pattern}', {group})"

    @staticmethod
    def swap(text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, r'{pattern}', '{to}')"

    @staticmethod
    def like(text: str, pattern: str) -> str:
        return f"({text} rlike r'{pattern}')"

    @staticmethod
    def keep(array: str, var: str, cond: str) -> str:
        return f"filter({array}, {var} -> {cond})"

    @staticmethod
    def map(array: str, var: str, expr: str) -> str:
        return f"transform({array}, {var} -> {expr})"

    @staticmethod
    def range(stop: str) -> str:
        return f"sequence(0, {stop})"

    @staticmethod
    def join(array: str, sep: str) -> str:
        return f"array_join({array}, {sep})"

    @staticmethod
    def json(text: str, key: str) -> str:
        return f"get_json_object({text}, '$.{key}')"

    @staticmethod
    def sha256(text: str) -> str:
        return f"sha2(cast({text} as binary), 256)"

    @staticmethod
    def slice(array: str, start: int, n: int) -> str:
        return f"slice({array}, {start}, {n})"

    newline = "'\\n'"


class Duck(Spark):
    idiv, st, g, rowfn, size, list_of = "//", "row", ", 'g'", "row", "len", "list"

    @staticmethod
    def days(end: str, start: str) -> str:
        return f"datediff('day', {start}, {end})"

    @staticmethod
    def hash32(text: str) -> str:
        return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"

    @staticmethod
    def each(array: str, name: str) -> str:
        return f", unnest({array}) {name}_t({name})"

    @staticmethod
    def each_at(array: str, name: str, pos: str) -> str:
        return f", lateral (select unnest({array}) {name}, generate_subscripts({array}, 1) - 1 {pos}) {name}_t"

    @staticmethod
    def split(text: str, sep: str) -> str:
        return f"string_split({text}, {'chr(10)' if sep == chr(92) + 'n' else repr(sep)})"

    @staticmethod
    def split_re(text: str, pattern: str) -> str:
        return f"regexp_split_to_array({text}, '{pattern}')"

    @staticmethod
    def found(text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, '{pattern}', {group})"

    @staticmethod
    def first(text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"

    @staticmethod
    def swap(text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"

    @staticmethod
    def like(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    @staticmethod
    def keep(array: str, var: str, cond: str) -> str:
        return f"list_filter({array}, lambda {var}: {cond})"

    @staticmethod
    def map(array: str, var: str, expr: str) -> str:
        return f"list_transform({array}, lambda {var}: {expr})"

    @staticmethod
    def range(stop: str) -> str:
        return f"generate_series(0, {stop})"

    @staticmethod
    def join(array: str, sep: str) -> str:
        return f"array_to_string({array}, {sep})"

    @staticmethod
    def json(text: str, key: str) -> str:
        return f"json_extract_string({text}, '$.{key}')"

    @staticmethod
    def sha256(text: str) -> str:
        return f"sha256({text})"

    @staticmethod
    def slice(array: str, start: int, n: int) -> str:
        return f"list_slice({array}, {start}, {start + n - 1})"

    newline = "chr(10)"
