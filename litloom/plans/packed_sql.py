"""SQL for the packed fields: the same values by replacement alone, since the SQL engine's patterns can't look around.

Circled letters stand for a split, a quote, and shielded delimiters and commas. Quotes are marked in two passes each,
because a match takes up the delimiter that the next quote needs in front of it; commas before initials are kept the
same way.
"""

_INITIALS = r"""',(\s*)((?:\p{Lu}\p{M}?\.?[\s-]?){1,4}|(?:Jr|Sr)\.?|II|III|IV)(\s*(?:,|$))', 'Ⓒ\1\2\3', 'g'"""


def _quoted(value: str) -> str:
    for pattern in ("q1", "q1", "q2", "q2", "q3", "q3"):
        value = rf"regexp_replace({value}, {pattern}, '\1\2Ⓠ\3Ⓠ\4\5', 'g')"
    return value


_TEMPLATE = r"""WITH v0 AS (SELECT meta_id, 'authors' AS field, authors AS v FROM paper_meta UNION ALL SELECT meta_id, 'declared_file', declared_file FROM paper_meta),
 v1 AS (SELECT meta_id, field, replace(replace(replace(replace(regexp_replace(coalesce(v, ''), '[\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]', ' ', 'g'), '\;', 'ⓢ'), '\,', 'ⓒ'), '\|', 'ⓟ'), '\&', 'ⓐ') AS v,
   CASE field WHEN 'authors' THEN '(?:[;|\n\t&,•·]|\s//?\s|(?i:\band\b))' ELSE '(?:[;|\n\t,•]|\s//\s)' END AS stop FROM v0),
 v2 AS (SELECT *, '(^|' || stop || ')(\s*)"([^"]*)"(\s*)($|' || stop || ')' AS q1, '(^|' || stop || ')(\s*)\{([^{}]*)\}(\s*)($|' || stop || ')' AS q2, '(^|' || stop || ')(\s*)''([^\n]*?)''(\s*)($|' || stop || ')' AS q3 FROM v1),
 v3 AS (SELECT meta_id, field, <quoted> AS v FROM v2),
 v4 AS (SELECT meta_id, field, string_split(v, 'Ⓠ') AS pieces FROM v3),
 v5 AS (SELECT meta_id, field, string_split(array_to_string(list_transform(pieces, lambda p, i: CASE WHEN i % 2 = 0 THEN 'Ⓠ' || p WHEN field = 'authors' THEN
     array_to_string(list_transform(string_split(regexp_replace(p, '(?:\s+|^|,\s*)(?i:and)(?:\s+|$)|\s+//?\s+|\s*[;|\n\t&•·]\s*', 'Ⓢ', 'g'), 'Ⓢ'), lambda s: CASE WHEN regexp_matches(s, '^\s*(?:\p{Ll}+\s+)*[\p{L}\p{M}''’-]+\s*,\s*\p{Lu}[\p{Ll}\p{M}]+(?:\s+(?:\p{Lu}\.\s?)+)?\s*$') THEN s
       ELSE replace(regexp_replace(regexp_replace(regexp_replace(s, <initials>), <initials>), '\s*,\s*', 'Ⓢ', 'g'), 'Ⓒ', ',') END), 'Ⓢ')
     ELSE regexp_replace(regexp_replace(p, '\s*[;|\n\t•]\s*|\s+//\s+|^\s*,\s*|\s*,\s*$', 'Ⓢ', 'g'), '(\.[A-Za-z0-9]{2,5}|:[a-z]{2,20}/[A-Za-z0-9.+-]{2,40})\s*,\s*', '\1Ⓢ', 'g') END), ''), 'Ⓢ') AS parts FROM v4),
 v6 AS (SELECT meta_id, field, CASE WHEN field = 'authors' THEN list_filter(list_transform(parts, lambda x: CASE WHEN contains(x, 'Ⓠ') THEN x ELSE regexp_replace(x, '[\s,]+(?:(?i:et\.?\s*al\.?|and\s+others)|u\.\s?a\.|…)\s*$', '') END),
     lambda x: NOT regexp_full_match(regexp_replace(regexp_replace(x, '^[\s,.]+', ''), '\s+$', ''), '(?:and\s+|&\s*)?(?:(?i:others|et\.?\s*al\.?)|u\.\s?a\.|(?i:and\s+colleagues)|\.\.\.|…)')) ELSE parts END AS parts FROM v5),
 v7 AS (SELECT meta_id, field, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(x, 'Ⓠ', ''), 'ⓢ', ';'), 'ⓒ', ','), 'ⓟ', '|'), 'ⓐ', '&'), '\s+', ' ', 'g')), '([^.\s])\s*,$', '\1'), '^\s+', ''))), lambda x: regexp_replace(x, '[\s,;|]+', '', 'g') <> '') AS items FROM v6)
SELECT meta_id, field, (generate_subscripts(items, 1) - 1)::INTEGER AS pos, unnest(items) AS item FROM v7 WHERE len(items) > 0"""

PACKED_FIELDS = _TEMPLATE.replace("<quoted>", _quoted("v")).replace("<initials>", _INITIALS)
