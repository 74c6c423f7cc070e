"""The SQL dialect: tokens that Spark SQL lacks or means otherwise are rewritten, the rest is Spark's.

Works on tokens, so strings, comments and quoted names are never touched by accident.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import InvalidQuery
from ..functions.durations import duration_micros, interval_text

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<number>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op><=|>=|<>|!=|=~|!~|\|\||::|.)""",
    re.S,
)
_PERCENTILE = re.compile(r"(?:percentile_|p)([0-9]{1,3})", re.I)
# Names with another name in Spark.
_RENAMED = {"average": "avg", "std_dev": "stddev", "stddev_samp": "stddev", "var_samp": "variance", "var": "variance"}
_TIME_NAMES = {"_time", "timestamp"}
_AGGREGATES = {"count", "sum", "avg", "mean", "min", "max", "first", "last", "stddev", "variance", "percentile", "min_by", "max_by"}
_SCHEMAS = {"information_schema": "information_schema_", "pg_catalog": "pg_catalog_"}


@dataclass
class Token:
    kind: str
    text: str

    def word(self, *names: str) -> bool:
        return self.kind == "word" and self.text.lower() in names


def tokenize(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql)]


def one_statement(sql: str) -> list[Token]:
    """The tokens of the only statement; anything after a semicolon but space is an error."""
    tokens = tokenize(sql)
    for i, t in enumerate(tokens):
        if t.text == ";" and t.kind == "op":
            if any(x.kind != "space" and x.text != ";" for x in tokens[i + 1 :]):
                raise InvalidQuery("one statement at a time")
            tokens = tokens[:i]
            break
    if not any(t.kind != "space" for t in tokens):
        raise InvalidQuery("an empty statement")
    return tokens


def _text(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def _skip(tokens: list[Token], i: int, step: int = 1) -> int:
    while 0 <= i < len(tokens) and tokens[i].kind == "space":
        i += step
    return i


def _closing(tokens: list[Token], i: int) -> int:
    """Index of the bracket that closes the one at ``i``."""
    depth = 0
    for k in range(i, len(tokens)):
        if tokens[k].kind == "op":
            depth += (tokens[k].text == "(") - (tokens[k].text == ")")
            if depth == 0:
                return k
    raise InvalidQuery("unbalanced brackets")


def _arguments(tokens: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in tokens:
        if t.kind == "op":
            depth += (t.text == "(") - (t.text == ")")
            if t.text == "," and depth == 0:
                out.append([])
                continue
        out[-1].append(t)
    return out


def _call(name: str, args: list[Token], over: str) -> str | None:
    """The Spark text of a call, or None to leave it. ``over``: the OVER clause that follows, if any."""
    low = _RENAMED.get(name.lower(), name.lower())
    inner = rewrite_tokens(args).strip()
    if low == "time_bucket":
        parts = _arguments(args)
        width = _text(parts[0]).strip()
        if width.lower().startswith("interval"):
            width = width[8:].strip()
        if len(parts) not in (2, 3) or not re.fullmatch(r"'[^']*'", width):
            raise InvalidQuery("time_bucket takes an interval, a time and, if wanted, an origin")
        size = duration_micros(width[1:-1])
        column = rewrite_tokens(parts[1]).strip()
        if len(parts) == 3:
            from ..functions.durations import micros, timestamp

            literal = re.sub(r"(?i)^timestamp\s*", "", _text(parts[2]).strip())
            offset = micros(timestamp(literal.strip("'"))) % size
            return f"window({column}, '{interval_text(size)}', '{interval_text(size)}', '{interval_text(offset)}').start"
        return f"window({column}, '{interval_text(size)}').start"
    if m := _PERCENTILE.fullmatch(low):
        if int(m.group(1)) > 100:
            raise InvalidQuery(f"no such percentile: {name}")
        return f"percentile({inner}, {int(m.group(1)) / 100}){over}"
    if low in ("first", "last") and len(_arguments(args)) == 1:
        if over:
            return f"{low}_value({inner}) IGNORE NULLS{over}"
        by = "min_by" if low == "first" else "max_by"
        return f"{by}({inner}, CASE WHEN ({inner}) IS NOT NULL THEN time END)"
    if low in ("stddev", "variance"):
        spark = "stddev_samp" if low == "stddev" else "var_samp"
        return f"CASE WHEN count({inner}){over} = 1 THEN 0.0D ELSE {spark}({inner}){over} END"
    if low != name.lower():
        return f"{low}({inner}){over}"
    return None


def answer_calls(tokens: list[Token], answers: dict[str, str]) -> list[Token]:
    """Calls without arguments of the functions in ``answers`` replaced by their text."""
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "word" and t.text.lower() in answers:
            a = _skip(tokens, i + 1)
            b = _skip(tokens, a + 1)
            if b < len(tokens) and tokens[a].text == "(" and tokens[b].text == ")":
                t, i = Token("string", answers[t.text.lower()]), b
        out.append(t)
        i += 1
    return out


def rewrite_tokens(tokens: list[Token]) -> str:
    out: list[str] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        after = _skip(tokens, i + 1)
        follows = tokens[after] if after < len(tokens) else Token("end", "")
        before = _skip(tokens, i - 1, -1)
        precedes = tokens[before] if before >= 0 else Token("end", "")
        if t.kind == "quoted" and t.text[0] == '"':
            out.append("`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif t.word("public") and follows.text == ".":
            i = after
        elif t.kind == "word" and t.text.lower() in _SCHEMAS and follows.text == ".":
            out.append(_SCHEMAS[t.text.lower()])
            i = after
        elif t.kind == "word" and follows.text == "(":
            close = _closing(tokens, after)
            args = tokens[after + 1 : close]
            over, end = "", close
            k = _skip(tokens, close + 1)
            if k < len(tokens) and tokens[k].word("over"):
                b = _skip(tokens, k + 1)
                if b < len(tokens) and tokens[b].text == "(":
                    end = _closing(tokens, b)
                    over = f" OVER ({rewrite_tokens(tokens[b + 1 : end])})"
                elif b < len(tokens) and tokens[b].kind == "word":
                    end, over = b, f" OVER {tokens[b].text}"
            new = _call(t.text, args, over)
            if new is None:
                out.append(f"{t.text}({rewrite_tokens(args)}){over}")
            else:
                out.append(new)
            i = end
        elif t.kind == "word" and t.text.lower() in _TIME_NAMES and follows.kind != "string" and not precedes.word("as") and precedes.text not in ("::", "."):
            out.append("time")
        elif t.word("limit") and follows.kind == "number":
            comma = _skip(tokens, after + 1)
            count = _skip(tokens, comma + 1)
            if comma < len(tokens) and tokens[comma].text == "," and count < len(tokens) and tokens[count].kind == "number":
                out.append(f"LIMIT {tokens[count].text} OFFSET {follows.text}")
                i = count
            else:
                out.append(t.text)
        else:
            out.append(t.text)
        i += 1
    return "".join(out)


def _default_order(tokens: list[Token]) -> bool:
    """Whether a plain SELECT with LIMIT has no order of its own: then the newest rows come first."""
    depth, words, calls = 0, set(), set()
    for i, t in enumerate(tokens):
        if t.kind == "op":
            depth += (t.text == "(") - (t.text == ")")
        if t.kind == "word":
            k = _skip(tokens, i + 1)
            if k < len(tokens) and tokens[k].text == "(":
                calls.add(_PERCENTILE.sub("percentile", _RENAMED.get(t.text.lower(), t.text.lower())))
            elif depth == 0:
                words.add(t.text.lower())
    return {"select", "from", "limit"} <= words and not words & {"order", "group", "distinct", "join", "union", "intersect", "except", "with", "having"} and not calls & _AGGREGATES


def to_spark_sql(sql: str, answers: dict[str, str] | None = None) -> str:
    """One statement of the dialect as Spark SQL; ``answers``: SQL texts of calls without arguments."""
    tokens = answer_calls(one_statement(sql), answers or {})
    if _default_order(tokens):
        at = next(i for i, t in enumerate(tokens) if t.word("limit"))
        tokens = [*tokens[:at], *tokenize("ORDER BY time DESC "), *tokens[at:]]
    return rewrite_tokens(tokens).strip()
