"""The text algebra in DuckDB's dialect, for oracles."""

from __future__ import annotations

from textlake.functions import text as T

NOTHING = "''"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TOKEN, PIECE = quoted(T.TOKEN), quoted(T.PIECE)


def norm(x: str) -> str:
    drop = quoted(f"[{T.POINTS}{T.GERESH}{T.GERSHAYIM}'\"]")
    return f"lower(translate(regexp_replace({x}, {drop}, '', 'g'), '{T.FINALS}', '{T.REGULAR}'))"


def prefixes(n: str) -> str:
    """No look-ahead in RE2: two letters and three more, else one and three more."""
    two, one = f"'^[{T.PREFIXES}]{{2}}[{T.LETTERS}]{{3,}}$'", f"'^[{T.PREFIXES}][{T.LETTERS}]{{3,}}$'"
    return f"(CASE WHEN regexp_matches({n}, {two}) THEN substr({n}, 3) WHEN regexp_matches({n}, {one}) THEN substr({n}, 2) ELSE {n} END)"


def suffixes(b: str) -> str:
    return f"regexp_replace({b}, '^(.{{2,}}?)(?:{'|'.join(T.SUFFIXES)})$', '\\1')"


def stem(n: str) -> str:
    return f"(CASE WHEN regexp_matches({n}, '^[{T.LETTERS}]+$') THEN {suffixes(prefixes(n))} ELSE {n} END)"


def norms(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, {TOKEN}), lambda x: {norm('x')}), lambda x: x <> '')"


def fold(t: str, vy: bool = True, aa: bool = True) -> str:
    drop = ("וי" if vy else "") + ("עא" if aa else "")
    return f"coalesce(nullif(translate({t}, '{drop}', ''), ''), {t})" if drop else t


def tokens(src: str, id_: str = "doc_id", name: str = "tok") -> str:
    """A CTE (id, pos, surface, start, end_, norm, stem) over src(id, text)."""
    return f"""{name}_p AS (SELECT {id_}, unnest(range(0, len(ps))) AS i, unnest(ps) AS surface FROM (SELECT {id_}, regexp_extract_all(text, {PIECE}) AS ps FROM {src})),
{name}_o AS (SELECT *, CAST(sum(length(surface)) OVER (PARTITION BY {id_} ORDER BY i) AS INTEGER) AS end_, {norm('surface')} AS norm FROM {name}_p),
{name} AS (SELECT {id_}, CAST(row_number() OVER (PARTITION BY {id_} ORDER BY i) - 1 AS INTEGER) AS pos, surface, CAST(end_ - length(surface) AS INTEGER) AS start, end_, norm, {stem('norm')} AS stem
  FROM {name}_o WHERE regexp_matches(surface, {quoted('^[' + T.TOKEN_CLASS + ']')}) AND norm <> '')"""
