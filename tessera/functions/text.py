"""Text functions as Column expressions: evaluated in the JVM, inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip and \s take for white space, as a Java pattern.
SPACE = "[\\s\\x1c-\\x1f\\x85\\u00a0]"


def py_strip(c: Column) -> Column:
    """str.strip(): all Unicode white space at both ends."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def strip_think(c: Column) -> Column:
    """What follows the first ``</think>``, or all, stripped."""
    return py_strip(F.element_at(F.split(c, "</think>", 2), -1))


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\\r\\n?", "\n")


def between_sections(c: Column) -> Column:
    """The text between the JSON and the JSON_SCHEMA header, stripped; null where one is missing."""
    pattern = "(?is)===\\s*JSON\\s*===(.*?)===\\s*JSON_SCHEMA\\s*==="
    return F.when(F.regexp_like(c, F.lit(pattern)), py_strip(F.regexp_extract(c, pattern, 1)))


def after_schema_header(c: Column) -> Column:
    """What follows the first ``=== JSON Schema ===``, stripped; null without one."""
    pattern = "(?is)=== JSON Schema ===\\s*(.+)$"
    return F.when(F.regexp_like(c, F.lit(pattern)), py_strip(F.regexp_extract(c, pattern, 1)))


def fill_table(text: Column, table: Column) -> Column:
    return F.replace(text, F.lit("<original_table>"), table)


def user_prompt(request: Column, report: Column, schema: Column) -> Column:
    return F.concat(request, F.lit("\n\n=== Report ===\n"), report, F.lit("\n\n=== JSON Schema ===\n"), schema)


def file_id(stem: Column) -> Column:
    """The number in data_7 or data7; -1 for other stems."""
    digits = F.replace(F.replace(stem, F.lit("data_"), F.lit("")), F.lit("data"), F.lit(""))
    return F.coalesce(F.when(F.regexp_like(digits, F.lit("^\\s*[+-]?[0-9]+\\s*$")), F.trim(digits).try_cast("bigint")), F.lit(-1).cast("bigint"))


def chat(*turns: tuple[str, Column], role: str = "role", content: str = "content") -> Column:
    """A message array of (role, content) pairs; with role="from" and content="value" the other common form."""
    return F.array(*[F.struct(F.lit(r).alias(role), c.alias(content)) for r, c in turns])


def sharegpt(*turns: tuple[str, Column]) -> Column:
    return chat(*turns, role="from", content="value")


def drop_system_prefix(c: Column) -> Column:
    return py_strip(F.regexp_replace(c, "(?iU)^\\s*SYSTEM:\\s*", ""))


def parse_paragraph_chat(c: Column, join_paragraphs: bool = False) -> Column:
    """Turns of a transcript in paragraphs; those without a speaker are dropped, or with ``join_paragraphs`` go to the turn before."""
    if join_paragraphs:
        c = F.regexp_replace(c, "\\n{2,}(?!\\s*(?:USER|ASSISTANT|FUNCTION RESPONSE):)", "\n")
    speakers = {"USER:": "human", "ASSISTANT:": "gpt", "FUNCTION RESPONSE:": "observation"}

    def turn(p: Column) -> Column:
        p = py_strip(p)
        out = F.lit(None)
        for prefix, who in speakers.items():
            value = py_strip(F.replace(F.substr(p, F.lit(len(prefix) + 1)), F.lit("<|endoftext|>"), F.lit("")))
            out = F.when(p.startswith(prefix) & (value != ""), F.struct(F.lit(who).alias("from"), value.alias("value"))).otherwise(out)
        return out

    return F.filter(F.transform(F.split(c, "\\n{2,}"), turn), lambda t: t.isNotNull())


def parse_marker_chat(c: Column) -> Column:
    """Turns between USER: and ASSISTANT: wherever these stand; other text stays in the turn."""
    pattern = "(?sU)\\b(USER|ASSISTANT):\\s*(.*?)(?=\\b(?:USER|ASSISTANT):|\\z)"
    roles, texts = F.regexp_extract_all(c, F.lit(pattern), 1), F.regexp_extract_all(c, F.lit(pattern), 2)
    return F.zip_with(roles, texts, lambda r, t: F.struct(F.lower(r).alias("role"), py_strip(t).alias("content")))


def role_name(c: Column) -> Column:
    """human, gpt -> user, assistant; others stay."""
    return F.when(c == "human", "user").when(c == "gpt", "assistant").otherwise(c)


def safe_file_name(c: Column) -> Column:
    return py_strip(F.regexp_replace(c, "[^\\p{L}\\p{N} ._]", ""))


def safe_sheet_name(c: Column) -> Column:
    return F.translate(c, "/\\", "__")


def header_name(c: Column) -> Column:
    return F.replace(py_strip(c), F.lit("\n"), F.lit(" "))


def with_markdown(prompt: Column, markdown: Column) -> Column:
    return F.concat(prompt, F.lit("=======INPUT MARKDOWN======"), markdown)


def by_language(file_number: Column, english: Column, korean: Column, border: int = 20_000) -> Column:
    return F.when(file_number >= border, english).otherwise(korean)


def last_content(messages: Column) -> Column:
    """The content of the last message that has one."""
    return F.try_element_at(F.filter(messages, lambda m: m["content"].isNotNull()), F.lit(-1))["content"]


def model_path(path: Column) -> Column:
    """struct(repo, subfolder): a relative path of more than two parts names a folder in a repository."""
    parts = F.split(path, "/")
    deep = (F.size(parts) > 2) & ~path.startswith("/")
    return F.struct(F.when(deep, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(path).alias("repo"), F.when(deep, F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/")).alias("subfolder"))


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def display_cell(c: Column, most: int = 32_000) -> Column:
    """Cut for a spreadsheet cell, with a mark where something is missing."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def status_label(no_output: Column, schema_valid: Column) -> Column:
    return F.when(no_output, "FAIL").when(schema_valid, "OK").otherwise("WARN")


def judge_score(reply: Column) -> Column:
    """0..1 from the first digit 1..5 of a judge's reply; null without one."""
    return (F.regexp_extract(reply, "[1-5]", 0).try_cast("double") - 1) / 4


def approx_tokens(c: Column) -> Column:
    """Words and single marks: an approximation, for where no tokenizer is given."""
    return F.coalesce(F.regexp_count(c, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]")), F.lit(0)).cast("bigint")


def detail_links(html: Column, base: str) -> Column:
    """Distinct absolute links to /data/.../fileData.do, sorted."""
    links = F.regexp_extract_all(html, F.lit("href=[\"']([^\"']*)[\"']"), 1)
    kept = F.filter(links, lambda x: x.contains("/data/") & x.endswith("/fileData.do"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.when(x.startswith("/"), F.concat(F.lit(base), x)).otherwise(x))))
