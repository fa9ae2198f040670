"""Reading model answers leniently: a bad answer becomes a reject, never a failed job. Decoding stays in Catalyst (Variant)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kinds import catalogue
from .text import clamp, let, strip

VERDICTS = ("established", "contradicted", "unsettled")
FIELD_ORDER = ("file", "line", "type", "title", "confidence", "quote")


def response_schema(types: list[str] | None = None) -> dict:
    """The answer's JSON Schema, kinds limited to `types` (the catalogue); fields in the order they are generated in."""
    forms = {"line": "integer", "confidence": "number"}
    fields: dict = {name: {"type": forms.get(name, "string")} for name in FIELD_ORDER}
    fields["type"]["enum"] = list(types or catalogue())
    item = {"type": "object", "properties": fields, "required": list(FIELD_ORDER)}
    return {"type": "object", "properties": {"findings": {"type": "array", "items": item}}, "required": ["findings"]}


def verdict_schema() -> dict:
    """The verdict comes last: a reason written after it could only defend it."""
    cited = {"file": {"type": "string"}, "line": {"type": "integer"}, "quote": {"type": "string"}}
    evidence = {"type": "array", "items": {"type": "object", "properties": cited, "required": list(cited)}}
    fields = {"needed": {"type": "string"}, "evidence": evidence, "reason": {"type": "string"}, "verdict": {"type": "string", "enum": list(VERDICTS)}}
    return {"type": "object", "properties": fields, "required": list(fields)}


def _text(item: Column, name: str) -> Column:
    """A field as text, empty if missing."""
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(""))


def _read(text: Column, made: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """made of an answer's text, its document, the document's kind and its list, each of which is computed once: a filter on what follows from them would decode the answer again."""
    listed = lambda t, doc, kind: let(F.try_variant_get(doc, "$.findings", "variant"), lambda found: made(t, doc, kind, found))
    decoded = lambda t: let(F.try_parse_json(t), lambda doc: let(F.schema_of_variant(doc), lambda kind: listed(t, doc, kind)))
    return let(strip(F.coalesce(text, F.lit(""))), decoded)


def _fault(text: Column, doc: Column, kind: Column, found: Column) -> Column:
    """(stage, detail, payload) of an answer that lists nothing, else null."""
    said = lambda stage, detail: F.struct(F.lit(stage).alias("stage"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), F.left(text, F.lit(500)).alias("payload"))
    return (
        F.when(text == "", said("empty", "nothing was answered"))
        .when(doc.isNull(), said("json", "the answer does not parse"))
        .when(~kind.startswith("OBJECT"), said("shape", F.concat(F.lit("the answer is of type "), kind)))
        .when(found.isNull() | F.is_variant_null(found), said("shape", "the answer lists nothing under `findings`"))
        .when(~F.schema_of_variant(found).startswith("ARRAY"), said("shape", "`findings` holds something other than a list"))
    )


def _entries(found: Column) -> Column:
    """The entries of an answer's list: an array of (ord, item, line, file, stage, detail), the last two null of those that can be read."""

    def entry(item: Column, k: Column, is_object: Column, line: Column, file: Column) -> Column:
        why = F.when(~is_object, "item").when(line.isNull() | (line < 1), "line").when(file == "", "file")
        words = (
            F.when(~is_object, "an entry of the list is a bare value")
            .when(line.isNull(), "no whole number says which line")
            .when(line < 1, "lines are counted from 1")
            .when(file == "", "no file is named")
        )
        return F.struct(k.cast("long").alias("ord"), item.alias("item"), line.alias("line"), file.alias("file"), why.alias("stage"), words.alias("detail"))

    is_object = lambda item: F.schema_of_variant(item).startswith("OBJECT")
    file = lambda item: F.translate(strip(_text(item, "file")), "\\", "/")
    one = lambda item, k: let(is_object(item), lambda o: let(F.try_variant_get(item, "$.line", "int"), lambda line: let(file(item), lambda f: entry(item, k, o, line, f))))
    return F.transform(F.try_variant_get(found, "$", "array<variant>"), one)


#: An entry as it is read at once. A field of another type is null, and so is an entry that is no object.
_ENTRY = "struct<file: string, line: int, type: string, title: string, confidence: variant, quote: string>"


def claims_of(text: Column) -> Column:
    """The claims of an answer: an array of (ord, file, line, type, title, confidence, quote), null or empty if it lists nothing that can be read. The list is taken out of the answer in one go."""
    said = lambda c: F.coalesce(c, F.lit(""))

    def claim(x: Column, k: Column, file: Column) -> Column:
        number = F.try_variant_get(x["confidence"], "$", "double")
        made = F.struct(
            k.cast("long").alias("ord"),
            file.alias("file"),
            x["line"].alias("line"),
            strip(said(x["type"])).alias("type"),
            strip(said(x["title"])).alias("title"),
            F.when(x["confidence"].isNull(), 1.0).otherwise(clamp(number)).alias("confidence"),
            said(x["quote"]).alias("quote"),
        )
        return F.when((x["line"] >= 1) & (file != ""), made)

    whole = F.when(text.startswith("{") & text.endswith("}"), text).otherwise(strip(said(text)))
    listed = F.try_variant_get(F.try_parse_json(whole), "$.findings", f"array<{_ENTRY}>")
    return F.array_compact(F.transform(listed, lambda x, k: let(F.translate(strip(said(x["file"])), "\\", "/"), lambda file: claim(x, k, file))))


def parse_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers (case_id, text) -> (claims: case_id, ord, file, line, type, title, confidence, quote; rejects: case_id, stage, detail, payload).

    A missing confidence is 1, a null or unreadable one 0. Duplicate keys and NaN make an answer unreadable.
    """
    # The outer form makes no filter, which would make the array once more.
    claims = answers.select("case_id", F.inline_outer(claims_of(F.col("text")))).filter("ord IS NOT NULL")

    odd = lambda found: F.transform(F.filter(_entries(found), lambda e: e["stage"].isNotNull()), lambda e: F.struct(e["stage"].alias("stage"), e["detail"].alias("detail"), F.left(F.to_json(e["item"]), F.lit(200)).alias("payload")))
    rejected = _read(F.col("text"), lambda t, doc, kind, found: let(_fault(t, doc, kind, found), lambda fault: F.when(fault.isNull(), odd(found)).otherwise(F.array(fault))))
    return claims, answers.select("case_id", F.inline_outer(rejected)).filter("stage IS NOT NULL")


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """answers with `text` -> the same and verdict, needed, reason, evidence. What can't be read, or is no object or no verdict, is unsettled."""
    docs = answers.withColumn("_doc", F.try_parse_json(strip(F.coalesce("text", F.lit("")))))
    readable = F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False))
    said = F.try_variant_get("_doc", "$.verdict", "string")
    items = F.filter(
        F.coalesce(F.try_variant_get("_doc", "$.evidence", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.schema_of_variant(e).startswith("OBJECT")
    )
    evidence = F.transform(
        items,
        lambda e: F.struct(_text(e, "file").alias("file"), F.try_variant_get(e, "$.line", "int").alias("line"), _text(e, "quote").alias("quote")),
    )
    out = docs.withColumn("verdict", F.when(readable & said.isin(*VERDICTS), said).otherwise("unsettled"))
    return (
        out.withColumn("needed", F.when(readable, _text(F.col("_doc"), "needed")).otherwise(""))
        .withColumn("reason", F.when(readable, _text(F.col("_doc"), "reason")).otherwise("unreadable answer"))
        .withColumn("evidence", F.when(readable, evidence).otherwise(F.array().cast("array<struct<file: string, line: int, quote: string>>")))
        .drop("_doc")
    )


#: A writer that is made once; json.dumps makes one for each answer.
_WRITER = json.JSONEncoder(ensure_ascii=False)


def render_answer(claims: list[dict]) -> str:
    """Claims as an answer's text, for stubs."""
    rows = [{k: c[k] for k in FIELD_ORDER if k != "quote" or c.get("quote")} for c in claims]
    return _WRITER.encode({"findings": rows})
