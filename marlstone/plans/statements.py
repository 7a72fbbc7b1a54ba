"""Statements: SELECT, EXPLAIN SELECT, COPY (SELECT ...) TO."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import ParseError, UnsupportedError
from ..operators.sinks import ParquetOptions
from .tokens import Token, meaningful, text, tokenize


@dataclass(frozen=True)
class Select:
    sql: str


@dataclass(frozen=True)
class Explain:
    sql: str


@dataclass(frozen=True)
class Copy:
    """COPY (sql) TO path. single: one file; otherwise a folder of parts."""

    sql: str
    path: str
    format: str = "csv"
    header: bool = False
    parquet: ParquetOptions = field(default_factory=ParquetOptions)
    single: bool = True


def split_statements(sql: str) -> list[str]:
    """The statements of a text; a semicolon in quotes or comments ends none."""
    out: list[list[Token]] = [[]]
    for t in tokenize(sql):
        if t.kind == "sign" and t.text == ";":
            out.append([])
        else:
            out[-1].append(t)
    return [text(s).strip() for s in out if any(t.kind != "space" for t in s)]


def parse_statement(sql: str) -> Select | Explain | Copy:
    parts = split_statements(sql)
    if len(parts) != 1:
        raise ParseError(f"one statement is needed, not {len(parts)}")
    tokens = tokenize(parts[0])
    at = meaningful(tokens)
    first = tokens[at[0]].upper
    if first in ("SELECT", "WITH", "(", "VALUES"):
        return Select(parts[0])
    if first == "EXPLAIN":
        second = tokens[at[1]].upper if len(at) > 1 else ""
        if second not in ("SELECT", "WITH", "("):
            raise UnsupportedError("EXPLAIN takes a SELECT and no options")
        return Explain(text(tokens[at[1] :]))
    if first == "COPY":
        return _copy(tokens, at)
    raise UnsupportedError(f"{first} statements are left out")


def _copy(tokens: list[Token], at: list[int]) -> Copy:
    words = [tokens[i] for i in at]
    if len(words) < 2 or words[1].text != "(":
        raise UnsupportedError("COPY takes a query in parentheses")
    depth, k = 0, 1
    while k < len(words):
        depth += {"(": 1, ")": -1}.get(words[k].text, 0)
        if not depth:
            break
        k += 1
    query = text(tokens[at[1] + 1 : at[k]]).strip() if k < len(words) else ""
    rest = words[k + 1 :]
    if not query or len(rest) < 2 or rest[0].upper != "TO" or rest[1].kind != "string":
        raise ParseError("COPY (query) TO 'path' is needed")
    inner = parse_statement(query)
    if not isinstance(inner, Select):
        raise UnsupportedError("COPY takes a SELECT")
    options = _options(rest[2:])
    kind = options.pop("FORMAT", "csv").lower()
    if kind not in ("csv", "parquet"):
        raise UnsupportedError(f"COPY can't write {kind}")
    path = rest[1].text[1:-1].replace("''", "'")
    single = _flag(options.pop("SINGLE", "true"))
    if kind == "csv":
        header = _flag(options.pop("HEADER", "false"))
        if options:
            raise UnsupportedError(f"CSV has no option {', '.join(options)}")
        return Copy(query, path, kind, header, single=single)
    got = ParquetOptions(
        compression=options.pop("COMPRESSION", "snappy").lower(),
        dictionary=_flag(options.pop("DICTIONARY", "true")),
        row_group_size=_number(options.pop("ROW_GROUP_SIZE", None)),
        write_batch_size=_number(options.pop("WRITE_BATCH_SIZE", None)),
        data_page_row_count_limit=_number(options.pop("DATA_PAGE_ROW_COUNT_LIMIT", None)),
    )
    if options:
        raise UnsupportedError(f"Parquet has no option {', '.join(options)}")
    got.settings()
    return Copy(query, path, kind, parquet=got, single=single)


def _options(words: list[Token]) -> dict[str, str]:
    """(NAME value, ...), or the same without parentheses or after WITH."""
    if words and words[0].upper == "WITH":
        words = words[1:]
    if words and words[0].text == "(":
        if words[-1].text != ")":
            raise ParseError("the options aren't closed")
        words = words[1:-1]
    out: dict[str, str] = {}
    item: list[Token] = []
    for w in [*words, Token("sign", ",")]:
        if w.text != ",":
            item.append(w)
            continue
        if item:
            value = item[-1].text.strip("'") if len(item) > 1 else "true"
            if len(item) > 2 or item[0].kind != "word" or item[0].upper in out:
                raise ParseError(f"no option: {text(item)}")
            out[item[0].upper] = value
        item = []
    return out


def _flag(v: str) -> bool:
    if v.lower() not in ("true", "false", "1", "0", "on", "off"):
        raise ParseError(f"neither true nor false: {v}")
    return v.lower() in ("true", "1", "on")


def _number(v: str | None) -> int | None:
    if v is None:
        return None
    if not v.isdigit() or int(v) == 0:
        raise ParseError(f"a positive number is needed, not {v}")
    return int(v)
