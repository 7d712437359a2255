"""The text rules of ``censo.functions.text`` as DuckDB SQL, for the checks beside the queries: entities as nested replacements."""

from __future__ import annotations

from censo.functions.text import ARTICLES, EDGES, IDENTITY_PUNCTUATION, PLACEHOLDERS

ENTITIES = {
    "&amp;": "&", "&#225;": "á", "&#233;": "é", "&#237;": "í", "&#243;": "ó", "&#250;": "ú", "&#241;": "ñ",
    "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú", "&ntilde;": "ñ",
}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(c: str) -> str:
    for code, letter in ENTITIES.items():
        c = f"replace({c}, '{code}', '{letter}')"
    return f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


def fold(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '\\s+', ' ', 'g'), {quote(EDGES)})"


def spaced_key(c: str) -> str:
    return "nullif(" + fold(f"translate({clean(c)}, {quote(IDENTITY_PUNCTUATION)}, {quote(' ' * len(IDENTITY_PUNCTUATION))})") + ", '')"


def match_key(c: str) -> str:
    return f"nullif(replace({spaced_key(c)}, ' ', ''), '')"


def place_key(c: str) -> str:
    turned = f"regexp_replace({fold(clean(c))}, '(?i)^(.+?)\\s*[,(\\[]\\s*({ARTICLES})\\s*[''´’]?\\s*[)\\]]?$', '\\2 \\1')"
    return f"coalesce({match_key(turned)}, '')"


def placeholder(c: str) -> str:
    return f"coalesce(trim({c}) <> '' AND ({fold(c)} = '' OR {fold(c)} IN ({', '.join(map(quote, PLACEHOLDERS))})), false)"


def values(rows: list[tuple[str, ...]], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) v({names}))"


def records() -> str:
    """CTE j(detalle_id, r): the valid records."""
    return "j AS (SELECT detalle_id, registro AS r FROM detalle WHERE json_valid(registro))"


def elements(path: str, name: str = "x", source: str = "j") -> str:
    """CTE name(detalle_id, pos, x): the elements of a list, a single object being one."""
    return f"""{name} AS (SELECT detalle_id, generate_subscripts(xs, 1) - 1 AS pos, unnest(xs) AS x FROM (SELECT detalle_id, CASE json_type(r, '{path}') WHEN 'ARRAY' THEN json_extract(r, '{path}[*]') WHEN 'OBJECT' THEN [json_extract(r, '{path}')] END AS xs FROM {source}))"""
