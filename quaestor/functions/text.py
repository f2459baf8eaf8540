"""Text expressions: cleaning, splitting, templates, verdicts and labels. Columns in, columns out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column, unicode: bool = True) -> Column:
    """Without white space at both ends; that of Unicode unless told otherwise."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$" if unicode else r"^\s+|\s+$", "")


def last_line(c: Column) -> Column:
    return F.element_at(F.split(c, "\n"), -1)


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "")


def before_first(c: Column, marker: str) -> Column:
    """The text before the first occurrence of a marker, or all of it."""
    return F.substring_index(c, marker, 1)


def keep_left(c: Column, separator: str) -> Column:
    """What is left of the last separator, or all."""
    escaped = "\\Q" + separator + "\\E"
    return F.regexp_replace(c, f"(?s){escaped}(?!.*{escaped}).*$", "")


def keep_right(c: Column, separator: str) -> Column:
    """What is right of the last separator, or all."""
    return F.substring_index(c, separator, -1)


def clean_report(c: Column) -> Column:
    """Drops the notice at the start, what follows the last underscore, and underscores; lower case, white space folded."""
    # Fixed value.
    c = F.regexp_replace(c, r"(?s)^\[\s*Report de-identified .+?\]\s*\n", "")
    c = F.regexp_replace(c, r"(?s)^(.*)_.*$", "$1")
    return strip(F.regexp_replace(F.lower(F.replace(c, F.lit("_"), F.lit(""))), r"(?U)\s+", " "))


def sentences(c: Column) -> Column:
    """Split at spaces after a full stop, exclamation or question mark."""
    return F.split(c, r"(?<=[.!?]) +")


def without_context_sentences(c: Column, strict: bool = False) -> Column:
    """Drops sentences that speak of the context and, if strict, of hallucinating."""
    words = ["context", *(["hallucinat"] if strict else [])]
    keep = lambda s: reduce(lambda a, b: a & b, [~F.lower(s).contains(w) for w in words])
    return F.array_join(F.filter(sentences(c), keep), " ")


def codes(c: Column) -> Column:
    """A list of codes: comma separated, blank ones dropped, stripped, without dots."""
    return F.transform(F.filter(F.split(c, ","), lambda x: strip(x) != ""), lambda x: F.replace(strip(x), F.lit("."), F.lit("")))


def without(values: Column, value: Column) -> Column:
    """All entries that differ from a value; other repeats stay."""
    return F.filter(values, lambda x: x != value)


def bracketed(c: Column) -> Column:
    """From the first [ to the last ]; null without either."""
    first, last = F.locate("[", c), F.length(c) - F.locate("]", F.reverse(c)) + 1
    return F.when((first > 0) & F.contains(c, F.lit("]")), F.substring(c, first, F.greatest(last - first + 1, F.lit(0))))


def qa_objects(c: Column) -> Column:
    """A JSON list of objects as maps of strings; values that are lists are joined by '; '."""
    value = lambda v: F.when(v.startswith("["), F.coalesce(F.array_join(F.from_json(v, "array<string>"), "; "), v)).otherwise(v)
    return F.transform(F.from_json(c, "array<map<string,string>>"), lambda m: F.transform_values(m, lambda _, v: value(v)))


def keys_are(m: Column, *names: str) -> Column:
    return F.array_sort(F.map_keys(m)) == F.array(*[F.lit(n) for n in sorted(names)])


def fill(template: Column, slots: list[tuple[str, Column]], optional: tuple[str, ...] = ()) -> Column:
    """Replaces slots one after the other, literally, so a later slot is also filled inside an earlier value.

    A slot named in ``optional`` stays as it is when its value is null or empty; other nulls count as empty.
    """
    for name, value in slots:
        new = F.replace(template, F.lit(name), F.coalesce(value, F.lit("")))
        template = F.when(value.isNull() | (value == ""), template).otherwise(new) if name in optional else new
    return template


def turns(prompt: Column) -> Column:
    """The chat turns of a prompt."""
    return F.split(prompt, "\n\\[next\\]\n")


def verdict(response: Column, supported: bool = False, trim: bool = True) -> Column:
    """1, 0, or 0.5 when the last line isn't a verdict. ``supported``: yes speaks for the answer, so it gives 0."""
    line = alphanumeric(last_line(strip(response) if trim else response))
    yes, no = (0.0, 1.0) if supported else (1.0, 0.0)
    return F.when(line.rlike("^Verdict(Yes|True)"), yes).when(line.rlike("^Verdict(No|False)"), no).otherwise(0.5)


def binarise(score: Column, threshold: float) -> Column:
    """1 from the threshold on, else 0; the threshold -1 keeps the score."""
    return F.when(F.lit(threshold) == -1, score).otherwise((score >= threshold).cast("double"))


def run_label(file: Column) -> Column:
    """METHOD (Role) by the name of a file without its suffix, with regard to case; the order of the tests matters."""
    # Fixed values.
    name = keep_left(keep_right(file, "/"), ".")
    method = F.when(name.contains("nocot"), "BCV").when(name.contains("cot"), "BCV-CoT").when(name.contains("sca"), "SCA").otherwise("BCV")
    role = F.when(name.contains("medical"), "Medical").when(name.contains("agnostic"), "Agnostic").otherwise("Unknown")
    return F.concat(method, F.lit(" ("), role, F.lit(")"))


def model_name(file: Column) -> Column:
    return keep_right(keep_left(file, "."), "_")


def report_block(complaint: Column, admit: Column, discharge: Column, text: Column) -> Column:
    """A report as one text."""
    # Fixed values.
    listed = F.array_join(F.transform(discharge, lambda d: F.concat(F.lit(" - "), d, F.lit("\n"))), "")
    return F.concat(F.lit("Chief Complaint: "), complaint, F.lit("\nAdmit Diagnosis: "), admit, F.lit("\nDischarge Diagnosis:\n"), listed, F.lit("Report Text: "), text, F.lit("\n\n"))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many digits after the point; ties of its shortest decimal form go to the even digit. Null, NaN and infinity give null."""
    return F.bround(c.try_cast("decimal(38,18)"), digits).cast(f"decimal(38,{digits})").cast("string")


def chosen(names: Column, suffix: str, *parts: str) -> Column:
    """Whether a file's name has the suffix and all the parts."""
    return reduce(lambda a, b: a & b, [names.endswith(suffix), *(names.contains(p) for p in parts)])


def first_present(*values: Column) -> Column:
    """The first value that isn't missing: of several names that an element may have, say."""
    return F.coalesce(*values)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Authority and path; null where the text isn't a URL."""
    return F.try_parse_url(url, F.lit("AUTHORITY")), F.try_parse_url(url, F.lit("PATH"))


def mentions(c: Column, phrase: str) -> Column:
    """Whether the text has a phrase, whatever the case."""
    return F.contains(F.lower(c), F.lit(phrase.lower()))


def duration(seconds: Column) -> Column:
    """Hours and minutes, both cut."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds / 60) % 60
    return F.concat(hours.cast("string"), F.lit(" hours and "), minutes.cast("string"), F.lit(" minutes"))


def output_path(path: str, model: str) -> str:
    """x.json -> x_MODEL.json, with colons as dashes."""
    stem, dot, suffix = path.rpartition(".")
    return f"{stem or suffix}_{model.replace(':', '-')}{dot}{suffix if dot else ''}"
