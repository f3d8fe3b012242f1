"""Pieces of SQL that several oracles share."""

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(text: str) -> str:
    """The words of an SQL expression as a list."""
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda x: x <> '')"


STEM = "coalesce(citation_in_text, '') || ' ' || coalesce(journal, '') || ' ' || coalesce(pmid, '')"
CUR = f"cur AS (SELECT *, {STEM} AS stem FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY loaded_at DESC NULLS LAST, ref_id DESC) AS rn FROM refs WHERE coalesce(pmid, '') <> '') WHERE rn = 1)"
LAST = "cat AS (SELECT nlmid, arg_max(journaltitle, ord) AS journaltitle, arg_max(medabbr, ord) AS medabbr, min(ord) AS first_ord FROM (SELECT trim(coalesce(nlmid, '')) AS nlmid, trim(coalesce(journaltitle, '')) AS journaltitle, trim(coalesce(medabbr, '')) AS medabbr, ord FROM journals) WHERE nlmid <> '' AND medabbr <> '' GROUP BY nlmid)"
FIRST_TEXT = "ft AS (SELECT stem, ext, full_text FROM (SELECT stem, ext, coalesce(full_text, '') AS full_text, row_number() OVER (PARTITION BY stem ORDER BY CASE ext WHEN 'md' THEN 1 ELSE 2 END, paper_id) AS rn FROM papers WHERE ext IN ('md', 'txt')) WHERE rn = 1)"
PATHS = {"stem": r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')"}
