"""The few places where Spark SQL and the SQL of the reference engine used in checks differ."""

from __future__ import annotations


class Spark:
    def numbered(self, order: str) -> tuple[str, str, str]:
        """A finding's case, its number among those of the case, and the rows with both.

        The case is one column for all, so that Spark knows the rows to lie by it; they are dealt and numbered as they were
        read, and what is made of their columns is made afterwards, so that it isn't shuffled."""
        dealt = "(SELECT *, l_orderkey AS case_id FROM lineitem) l JOIN part ON l_partkey = p_partkey"
        return "case_id", "seq", f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY {order}) AS seq FROM {dealt}) n"

    def re(self, pattern: str) -> str:
        return f'r"{pattern}"' if '"' not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def days(self, start: str, end: str) -> str:
        return f"datediff({end}, {start})"

    def rx(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, {self.re(pattern)}, {group})"

    def rx_all(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.re(pattern)}, {group})"

    def rx_replace(self, text: str, pattern: str, new: str) -> str:
        return f"regexp_replace({text}, {self.re(pattern)}, '{new}')"

    def rx_like(self, text: str, pattern: str) -> str:
        return f"regexp_like({text}, {self.re(pattern)})"

    def pick(self, values: list[str], index: str) -> str:
        return "element_at(array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + f"), CAST({index} AS INT) + 1)"

    def split(self, text: str, sep: str) -> str:
        return f"split({text}, {self.re(sep)})"

    def unnest(self, array: str, name: str) -> str:
        return f"LATERAL VIEW explode({array}) t_{name} AS {name}"

    def half_even(self, x: str, digits: int) -> str:
        return f"bround({x}, {digits})"

    def month(self, date: str) -> str:
        return f"date_format({date}, 'yyyy-MM')"

    def show_date(self, date: str) -> str:
        return f"date_format({date}, 'd MMM yyyy')"

    def seconds(self, ts: str) -> str:
        return f"unix_seconds(CAST({ts} AS TIMESTAMP))"

    def micros(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))"

    def array_sorted_text(self, expr: str) -> str:
        return f"array_join(array_sort(collect_set({expr})), ',')"

    def try_date(self, text: str) -> str:
        return f"try_cast({text} AS DATE)"

    def string_list(self, values: list[str]) -> str:
        return "array(" + ", ".join(f"'{v}'" for v in values) + ")"

    def numbers(self, values: list[str]) -> str:
        return "array(" + ", ".join(f"CAST({v} AS BIGINT)" for v in values) + ")"

    def shared(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def length(self, array: str) -> str:
        return f"size({array})"

    def first_by(self, value: str, order: str) -> str:
        return f"min_by({value}, {order})"

    def last_by(self, value: str, order: str) -> str:
        return f"max_by({value}, {order})"


class Duck(Spark):
    def numbered(self, order: str) -> tuple[str, str, str]:
        return "l_orderkey AS case_id", f"ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS seq", "lineitem JOIN part ON l_partkey = p_partkey"

    def re(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def days(self, start: str, end: str) -> str:
        return f"date_diff('day', {start}, {end})"

    def rx_replace(self, text: str, pattern: str, new: str) -> str:
        return f"regexp_replace({text}, {self.re(pattern)}, '{new}', 'g')"

    def rx_like(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.re(pattern)})"

    def pick(self, values: list[str], index: str) -> str:
        return "list_extract([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"], CAST({index} AS INT) + 1)"

    def split(self, text: str, sep: str) -> str:
        return f"string_split_regex({text}, {self.re(sep)})"

    def unnest(self, array: str, name: str) -> str:
        return f", LATERAL (SELECT unnest({array}) AS {name}) t_{name}"

    def half_even(self, x: str, digits: int) -> str:
        return f"round_even({x}, {digits})"

    def month(self, date: str) -> str:
        return f"strftime({date}, '%Y-%m')"

    def show_date(self, date: str) -> str:
        return f"strftime({date}, '%-d %b %Y')"

    def seconds(self, ts: str) -> str:
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def array_sorted_text(self, expr: str) -> str:
        return f"array_to_string(list_sort(list(DISTINCT {expr})), ',')"

    def string_list(self, values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    def numbers(self, values: list[str]) -> str:
        return "[" + ", ".join(f"CAST({v} AS BIGINT)" for v in values) + "]"

    def shared(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def length(self, array: str) -> str:
        return f"len({array})"

    def first_by(self, value: str, order: str) -> str:
        return f"arg_min({value}, {order})"

    def last_by(self, value: str, order: str) -> str:
        return f"arg_max({value}, {order})"
