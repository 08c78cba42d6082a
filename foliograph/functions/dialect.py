"""Expressions whose spelling differs between Spark SQL and DuckDB; all others are written in what both understand.

Regular expressions keep to what Java's and RE2's engines read alike: explicit character classes, no look-around, texts
stripped before a ``$``.
"""

from __future__ import annotations

import re

#: White space as Python's str.strip() and split() know it.
WS = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


#: The same class as Java tests it in two steps; the ranges above are eight there, each asked for every other character.
JAVA_WS = r"\p{IsWhite_Space}\x{1C}-\x{1F}"
#: Its characters one by one.
SPACES = [chr(c) for r in ((0x9, 0xD), (0x1C, 0x20), (0x85,) * 2, (0xA0,) * 2, (0x1680,) * 2, (0x2000, 0x200A), (0x2028, 0x2029), (0x202F,) * 2, (0x205F,) * 2, (0x3000,) * 2) for c in range(r[0], r[1] + 1)]


class Dialect:
    """Functions from expressions to expressions."""

    def string(self, value: str) -> str:
        raise NotImplementedError

    def rx(self, text: str, pattern: str, flags: str = "") -> str:
        """Whether a pattern is found anywhere. flags: i for either case."""
        raise NotImplementedError

    def count(self, text: str, pattern: str) -> str:
        raise NotImplementedError

    def replace(self, text: str, pattern: str, by: str = "") -> str:
        """Every match of a pattern replaced by fixed text."""
        raise NotImplementedError

    def extract(self, text: str, pattern: str, group: int = 1) -> str:
        """A group of the first match; empty if there is none."""
        return f"regexp_extract({text}, {self.string(pattern)}, {group})"

    def few_words(self, text: str, most: int, condition: str) -> str:
        """Whether a condition holds and the text has ``most`` words at most."""
        return f"({condition} AND {self.words(text)} <= {most})"

    def any_rx(self, text: str, patterns, flags: str = "") -> str:
        return "(" + " OR ".join(self.rx(text, p, flags) for p in patterns) + ")"

    def match(self, text: str, pattern: str, flags: str = "") -> str:
        """Whether a pattern matches at the start."""
        return self.rx(text, f"^(?:{pattern})", flags)

    def any_match(self, text: str, patterns, flags: str = "") -> str:
        return "(" + " OR ".join(self.match(text, p, flags) for p in patterns) + ")"

    def has(self, text: str, part: str) -> str:
        return f"contains({text}, {self.string(part)})"

    def has_any(self, text: str, parts) -> str:
        return "(" + " OR ".join(self.has(text, p) for p in parts) + ")"

    def isin(self, text: str, values) -> str:
        return f"({text} IN ({', '.join(self.string(v) for v in values)}))"

    def num(self, value: float) -> str:
        return f"CAST({value!r} AS DOUBLE)"

    def ratio(self, a: str, b: str) -> str:
        return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"

    def strip(self, text: str) -> str:
        return self.replace(text, f"^[{WS}]+|[{WS}]+$")

    def words(self, text: str) -> str:
        """How many words str.split() gives."""
        return f"CAST({self.count(text, f'[^{WS}]+')} AS INT)"

    def first_char(self, text: str) -> str:
        return f"substr({text}, 1, 1)"

    def upper(self, text: str) -> str:
        """str.isupper()"""
        return f"(upper({text}) = {text} AND lower({text}) <> {text})"

    def title(self, text: str) -> str:
        """str.istitle(): each run of cased letters is one capital and small ones."""
        cased = r"\p{Lu}\p{Ll}\p{Lt}"
        return f"({self.rx(text, r'[\p{Lu}\p{Lt}]')} AND NOT {self.rx(text, rf'(^|[^{cased}])\p{{Ll}}')} AND NOT {self.rx(text, rf'[{cased}][\p{{Lu}}\p{{Lt}}]')})"

    def lower_first(self, text: str) -> str:
        return self.rx(text, r"^\p{Ll}")

    def upper_first(self, text: str) -> str:
        return self.rx(text, r"^\p{Lu}")

    def cases(self, *pairs: tuple[str, str], otherwise: str = "NULL") -> str:
        """The value of the first condition that holds; an unknown condition doesn't."""
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"

    def points(self, *pairs: tuple[str, float]) -> str:
        """The sum of the points of all conditions that hold."""
        return "(" + " + ".join(f"(CASE WHEN {c} THEN {self.num(p) if isinstance(p, float) else p} ELSE {self.num(0.0) if isinstance(p, float) else 0} END)" for c, p in pairs) + ")"

    def listed(self, *pairs: tuple[str, str], by: str = ";") -> str:
        """The names of all conditions that hold, joined."""
        return f"concat_ws({self.string(by)}, " + ", ".join(f"CASE WHEN {c} THEN {self.string(n)} END" for c, n in pairs) + ")"

    def quantile(self, value: str, share: float, over: str = "") -> str:
        raise NotImplementedError

    def quantiles(self, value: str, shares, over: str = "") -> str:
        """An array of quantiles, in one aggregate."""
        raise NotImplementedError

    def item(self, array: str, place: int) -> str:
        """An element of an array, counted from 1; null beyond its end."""
        raise NotImplementedError

    def fixed(self, value: str, digits: int) -> str:
        """A number as text with so many decimals."""
        raise NotImplementedError

    def last_known(self, value: str, over: str) -> str:
        raise NotImplementedError

    def array_agg(self, value: str, order: str) -> str:
        raise NotImplementedError

    def joined(self, value: str, order: str, by: str = " ", where: str = "TRUE") -> str:
        """An aggregate: the values in an order, joined; of the rows for which a condition holds."""
        raise NotImplementedError

    def tokens(self, text: str, pattern: str) -> str:
        """All matches of a pattern, as an array."""
        raise NotImplementedError

    def keep(self, array: str, condition: str) -> str:
        """The elements x of an array for which a condition holds."""
        raise NotImplementedError

    def pairs(self, array: str) -> str:
        """Each two neighbours of an array of strings, with a space between."""
        raise NotImplementedError

    def array(self, values) -> str:
        raise NotImplementedError

    def split(self, text: str, by: str) -> str:
        """A text cut at a fixed string, as an array."""
        raise NotImplementedError

    def size(self, array: str) -> str:
        raise NotImplementedError

    def numbers(self, last: str) -> str:
        """The numbers from 1 to ``last``, as an array."""
        raise NotImplementedError

    def item_at(self, array: str, place: str) -> str:
        """An element of an array at a computed place, counted from 1."""
        raise NotImplementedError


class Spark(Dialect):
    #: Patterns as Java's engine, which tries every way at every place, finds them sooner; ``patterns`` has them.
    quick: dict[str, str] = {}
    #: What any match of a pattern holds.
    needs: dict[str, str] = {}

    def string(self, value: str) -> str:
        if "\\" in value or "'" in value:
            quote = '"' if '"' not in value else "'"
            if "'" in value and '"' in value:
                return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
            return f"r{quote}{value}{quote}"
        return f"'{value}'"

    def rx(self, text: str, pattern: str, flags: str = "") -> str:
        found = f"{text} RLIKE {self._java(('(?iud)' if 'i' in flags else '(?d)') + self.quick.get(pattern, pattern))}"
        return f"(contains({text}, '{self.needs[pattern]}') AND {found})" if pattern in self.needs else f"({found})"

    def _java(self, pattern: str) -> str:
        return self.string(pattern.replace(WS, JAVA_WS))

    def count(self, text: str, pattern: str) -> str:
        if not re.fullmatch(r"\[(?:\\.|[^\[\]\\])+\]", pattern):
            return f"regexp_count({text}, {self._java(pattern)})"
        # characters of a class: no array of them is made
        others = pattern[:1] + "^" + pattern[1:] if not pattern.startswith("[^") else "[" + pattern[2:]
        if r"\p{L}" in pattern:
            return f"length(regexp_replace({text}, {self._java(others + '+')}, ''))"
        return f"(length({text}) - length(regexp_replace({text}, {self._java(pattern + '+')}, '')))"

    def words(self, text: str) -> str:
        return f"length(regexp_replace({self.strip(text)}, {self._java(f'[^{WS}]+[{WS}]*')}, 'w'))"

    def few_words(self, text: str, most: int, condition: str) -> str:
        return f"({self.words(text)} <= {most} AND {condition})"

    def replace(self, text: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({text}, {self._java(pattern)}, {self.string(by)})"

    def extract(self, text: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({text}, {self._java(pattern)}, {group})"

    def strip(self, text: str) -> str:
        """Looks at the ends alone."""
        return "trim(BOTH '" + "".join(f"\\u{ord(c):04X}" for c in SPACES) + f"' FROM {text})"

    def quantile(self, value: str, share: float, over: str = "") -> str:
        return f"percentile({value}, {share!r}){f' OVER ({over})' if over else ''}"

    def quantiles(self, value: str, shares, over: str = "") -> str:
        return f"percentile({value}, array({', '.join(map(repr, shares))})){f' OVER ({over})' if over else ''}"

    def item(self, array: str, place: int) -> str:
        return f"get({array}, {place - 1})"

    def fixed(self, value: str, digits: int) -> str:
        return f"format_string('%.{digits}f', {value})"

    def last_known(self, value: str, over: str) -> str:
        return f"last_value({value}) IGNORE NULLS OVER ({over})"

    def array_agg(self, value: str, order: str, where: str = "TRUE") -> str:
        return f"transform(array_sort(collect_list(named_struct('o', {order}, 'v', {value})) FILTER (WHERE {where})), x -> x.v)"

    def joined(self, value: str, order: str, by: str = " ", where: str = "TRUE") -> str:
        return f"array_join({self.array_agg(value, order, where)}, {self.string(by)})"

    def tokens(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self._java(pattern)}, 0)"

    def keep(self, array: str, condition: str) -> str:
        return f"filter({array}, x -> {condition})"

    def pairs(self, array: str) -> str:
        n = f"greatest(size({array}) - 1, 0)"  # the array stays outside of the lambda, where it would be made again for each element
        return f"zip_with(slice({array}, 1, {n}), slice({array}, 2, {n}), (x, y) -> concat(x, ' ', y))"

    def array(self, values) -> str:
        return f"array({', '.join(map(str, values))})"

    def split(self, text: str, by: str) -> str:
        return f"split({text}, {self.string(re.escape(by))})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def numbers(self, last: str) -> str:
        return f"sequence(1, {last})"

    def item_at(self, array: str, place: str) -> str:
        return f"element_at({array}, {place})"


class Duck(Dialect):
    def string(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def rx(self, text: str, pattern: str, flags: str = "") -> str:
        return f"regexp_matches({text}, {self.string(('(?i)' if 'i' in flags else '') + pattern)})"

    def count(self, text: str, pattern: str) -> str:
        return f"len(regexp_extract_all({text}, {self.string(pattern)}))"

    def replace(self, text: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({text}, {self.string(pattern)}, {self.string(by)}, 'g')"

    def quantile(self, value: str, share: float, over: str = "") -> str:
        return f"quantile_cont(CAST({value} AS DOUBLE), {share!r}){f' OVER ({over})' if over else ''}"

    def quantiles(self, value: str, shares, over: str = "") -> str:
        return f"quantile_cont(CAST({value} AS DOUBLE), [{', '.join(map(repr, shares))}]){f' OVER ({over})' if over else ''}"

    def item(self, array: str, place: int) -> str:
        return f"{array}[{place}]"

    def fixed(self, value: str, digits: int) -> str:
        return f"printf('%.{digits}f', CAST({value} AS DOUBLE))"

    def last_known(self, value: str, over: str) -> str:
        return f"last_value({value} IGNORE NULLS) OVER ({over})"

    def array_agg(self, value: str, order: str) -> str:
        return f"list({value} ORDER BY {order})"

    def joined(self, value: str, order: str, by: str = " ", where: str = "TRUE") -> str:
        return f"coalesce(string_agg({value}, {self.string(by)} ORDER BY {order}) FILTER (WHERE {where}), '')"

    def tokens(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.string(pattern)})"

    def keep(self, array: str, condition: str) -> str:
        return f"list_filter({array}, lambda x: {condition})"

    def pairs(self, array: str) -> str:
        return f"list_transform(range(1, len({array})), lambda i: concat({array}[i], ' ', {array}[i + 1]))"

    def array(self, values) -> str:
        return f"[{', '.join(map(str, values))}]"

    def split(self, text: str, by: str) -> str:
        return f"string_split({text}, {self.string(by)})"

    def size(self, array: str) -> str:
        return f"len({array})"

    def numbers(self, last: str) -> str:
        return f"range(1, {last} + 1)"

    def item_at(self, array: str, place: str) -> str:
        return f"{array}[{place}]"


SPARK, DUCK = Spark(), Duck()
