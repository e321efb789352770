"""Cleaning of cells, codes, CSV cells and cross-references, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATA_COLUMNS = ("page", "level", "chinese", "english", "code")
#: The outline's indent sign, U+3000.
INDENT = "　"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_QUERY_CODE = r"^\d+(\.\d+)?$"

#: Fixed patterns of the two languages' references: group 1 is the kind, group 2 the target.
REFERENCE_ZH = r"(?U)(?:[-（(]?\s*)(另见|见)\s*([^；;\n]+)"
REFERENCE_EN = r"(?iU)\b(see also|see)\s+([^;\n]+)"
#: Targets that point to a subcategory are not followed.
NOT_FOLLOWED = ("亚目", "subcategory")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind (Unicode, and the separators U+001C to U+001F) at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parse_int(c: Column | str, default: int | None) -> Column:
    """Whole part of a number in text, towards zero; default for null, empty, NaN, infinite and other text."""
    s = strip(_col(c).cast("string"))
    x = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    return F.coalesce(F.when(F.abs(x) < 9.2e18, x.cast("bigint")), F.lit(default).cast("bigint"))


def parse_text(c: Column | str) -> Column:
    """Stripped; null and `nan` (tested before the strip) become empty."""
    c = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(F.lower(c) == "nan", "").otherwise(strip(c))


def strip_indent(c: Column | str) -> Column:
    return F.regexp_replace(parse_text(c), f"^{INDENT}*", "")


def search_text(fields=("chinese", "english", "code")) -> Column:
    """The lowered fields in the given order, joined by blanks; matches may run across the joints."""
    own = [F.lower(F.col(f)) for f in fields if f in ("chinese", "english", "code")]
    return strip(F.concat_ws(" ", *own)) if own else F.lit("")


def row_id(page="page", level="level", file="source_file", line="source_line") -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in (page, level, file, line)])


def normalize_code(c: Column | str) -> Column:
    """Without any white space, lowered."""
    return F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)[\s\x1c-\x1f]+", ""))


def code_key(normal: Column | str) -> Column:
    """major * 1000 + minor + 1 as one ordered number, whole codes before their first subcode; null if it is no plain code."""
    c = _col(normal)
    minor = F.rpad(F.regexp_extract(c, r"\.(\d{1,2})$", 1), 2, "0").cast("int")
    return F.when(
        c.rlike(r"^\d{1,2}(\.\d{1,2})?$"),
        F.regexp_extract(c, r"^\d+", 0).cast("int") * 1000 + F.when(c.contains("."), minor + 1).otherwise(0),
    ).cast("int")


def is_code_query(c: Column | str) -> Column:
    return _col(c).rlike(_QUERY_CODE)


def tree_preview(level="level", chinese="chinese") -> Column:
    return F.concat(F.repeat(F.lit(INDENT), F.greatest(F.col(level), F.lit(0)).cast("int")), F.col(chinese))


def csv_quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(_col(c), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_if_needed(c: Column | str) -> Column:
    return F.when(_col(c).rlike('[,"\\n\\r]'), csv_quoted(c)).otherwise(_col(c))


def csv_line() -> Column:
    """An index row in its file's form: texts always quoted, the code only if it must be."""
    return F.concat_ws(",", F.col("page").cast("string"), F.col("level").cast("string"), csv_quoted("chinese"), csv_quoted("english"), csv_if_needed("code"))


def _references(c: Column, pattern: str, lower_kind: bool) -> Column:
    kinds, targets = (F.regexp_extract_all(c, F.lit(pattern), k) for k in (1, 2))
    pairs = F.arrays_zip(kinds.alias("kind"), targets.alias("target"))
    clean = F.transform(pairs, lambda r: F.struct((F.lower(r["kind"]) if lower_kind else r["kind"]).alias("kind"), strip(r["target"]).alias("target")))
    return F.filter(clean, lambda r: r["target"] != "")


def extract_references(chinese="chinese", english="english") -> Column:
    """array<struct<lang, kind, target>>, Chinese ones first."""
    tagged = lambda refs, lang: F.transform(refs, lambda r: F.struct(F.lit(lang).alias("lang"), r["kind"].alias("kind"), r["target"].alias("target")))
    return F.concat(tagged(_references(F.col(chinese), REFERENCE_ZH, False), "zh"), tagged(_references(F.col(english), REFERENCE_EN, True), "en"))


def followed(target: Column) -> Column:
    low = F.lower(target)
    return (target != "") & ~low.contains(NOT_FOLLOWED[0]) & ~low.contains(NOT_FOLLOWED[1])


def reference_spans(title: Column, targets: Column) -> Column:
    """array<struct<start, end, target>>: first place of each target in the title, case-blind, greedily without overlap.

    If none is in the title, the first target stands behind it as a whole, at its end.
    """
    low = F.lower(title)
    placed = F.transform(targets, lambda t: F.struct((F.call_function("locate", F.lower(t), low) - 1).alias("start"), F.length(t).alias("n"), t.alias("target")))
    found = F.array_sort(F.transform(F.filter(placed, lambda m: m["start"] >= 0), lambda m: F.struct(m["start"].alias("start"), (-(m["start"] + m["n"])).alias("neg_end"), m["target"].alias("target"))))
    empty = F.array().cast("array<struct<start:int,end:int,target:string>>")

    def step(acc: Column, m: Column) -> Column:
        end = -m["neg_end"]
        more = F.concat(acc["out"], F.array(F.struct(m["start"].alias("start"), end.alias("end"), m["target"].alias("target"))))
        fits = m["start"] >= acc["last"]
        return F.struct(F.when(fits, end).otherwise(acc["last"]).alias("last"), F.when(fits, more).otherwise(acc["out"]).alias("out"))

    end = F.length(title)
    whole = F.when(F.size(targets) > 0, F.array(F.struct(end.alias("start"), end.alias("end"), targets[0].alias("target")))).otherwise(empty)
    return F.when(F.size(found) == 0, whole).otherwise(F.aggregate(found, F.struct(F.lit(-1).alias("last"), empty.alias("out")), step, lambda acc: acc["out"]))
