"""What a VARIANT must look like, and the path of the first place where it does not."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """Kind of a value (string, boolean, number, int, array, object), what it holds and its bounds; fields beyond those named may be there."""

    kind: str
    fields: dict[str, Shape] = field(default_factory=dict)
    item: Shape | None = None
    options: tuple[str, ...] = ()
    least: int = 0
    nullable: bool = False
    optional: bool = False


def string(least: int = 0, nullable: bool = False, optional: bool = False) -> Shape:
    """A string of at least ``least`` characters; an optional one may be left out, but not be null."""
    return Shape("string", least=least, nullable=nullable, optional=optional)


def one_of(*options: str, nullable: bool = False) -> Shape:
    """One of the given strings."""
    return Shape("string", options=options, nullable=nullable)


def boolean(nullable: bool = False) -> Shape:
    return Shape("boolean", nullable=nullable)


def number(nullable: bool = False) -> Shape:
    return Shape("number", nullable=nullable)


def whole(nullable: bool = False) -> Shape:
    """A number without fraction."""
    return Shape("int", nullable=nullable)


def many(item: Shape, least: int = 0, nullable: bool = False) -> Shape:
    """An array of at least ``least`` items."""
    return Shape("array", item=item, least=least, nullable=nullable)


def fields(nullable: bool = False, /, **named: Shape) -> Shape:
    """An object with these fields."""
    return Shape("object", fields=named, nullable=nullable)


def kind(value: Column) -> Column:
    """string, boolean, number, array, object, null, or undefined where there is no value."""
    name = F.substring_index(F.schema_of_variant(value), "<", 1)
    known = F.create_map(*[F.lit(x) for x in ("VOID", "null", "STRING", "string", "BOOLEAN", "boolean", "ARRAY", "array", "OBJECT", "object")])
    return F.when(value.isNull(), "undefined").otherwise(F.coalesce(F.element_at(known, name), F.lit("number")))


def first_error(value: Column, shape: Shape, path: Column | None = None) -> Column:
    """``path message`` of the first place, in order of the shape's fields and of items, where ``value`` breaks ``shape``; null if it fits.

    Steps of a path are joined by dots, items count from 0, and the path of the whole value is empty. An item's
    errors come before one of its array's length.
    """
    here = F.lit("") if path is None else path
    got = kind(value)
    inner: list[Column] = []
    if shape.options:
        listed = "|".join(f'"{o}"' for o in shape.options)
        known = F.coalesce((got == "string") & F.try_variant_get(value, "$", "string").isin(*shape.options), F.lit(False))
        wrong = F.when(~known, _say(here, F.lit(f"Invalid option: expected one of {listed}")))
    elif shape.kind == "int":
        exact = F.try_variant_get(value, "$", "decimal(38,10)")
        broken = F.when(got != "number", F.lit("Invalid input: expected number, received ")).when(F.coalesce(exact != F.floor(exact), F.lit(True)), "Invalid input: expected int, received ")
        wrong = _say(here, F.concat(broken, got))
    else:
        wrong = F.when(got != shape.kind, _say(here, F.concat(F.lit(f"Invalid input: expected {shape.kind}, received "), got)))
    for name, part in shape.fields.items():
        inner.append(first_error(F.try_variant_get(value, f"$.{name}", "variant"), part, _step(path, F.lit(name))))
    if shape.item is not None:
        held = F.try_variant_get(value, "$", "array<variant>")
        found = F.transform(held, lambda x, k: first_error(x, shape.item, _step(path, k.cast("string"))))
        inner.append(F.get(F.array_compact(found), 0))
    if shape.least:
        size = F.size(F.try_variant_get(value, "$", "array<variant>")) if shape.kind == "array" else F.length(F.try_variant_get(value, "$", "string"))
        unit = "items" if shape.kind == "array" else "characters"
        inner.append(F.when(size < shape.least, _say(here, F.lit(f"Too small: expected {shape.kind} to have >={shape.least} {unit}"))))
    error = F.coalesce(wrong, *inner) if inner else wrong
    fine = [name for name, may in (("null", shape.nullable), ("undefined", shape.optional)) if may]
    return F.when(~got.isin(*fine), error) if fine else error


def _fits(value: Column, shape: Shape) -> Column | None:
    """True only where ``value`` is an object of just these fields and fits ``shape``; None for shapes that are no flat objects of strings and booleans."""
    parts = shape.fields.items()
    if shape.kind != "object" or not shape.fields or any(p.kind not in ("string", "boolean") or not n.isidentifier() or not n.isascii() for n, p in parts):
        return None
    # names in the order in which a VARIANT keeps them
    exact = F.schema_of_variant(value) == "OBJECT<" + ", ".join(f"{n}: {p.kind.upper()}" for n, p in sorted(parts)) + ">"
    get = lambda name: F.try_variant_get(value, f"$.{name}", "string")
    bounds = [get(n).isin(*p.options) for n, p in parts if p.options] + [F.length(get(n)) >= p.least for n, p in parts if p.least]
    return F.coalesce(reduce(Column.__and__, bounds, exact), F.lit(False))


def first_fault(value: Column, shape: Shape) -> Column:
    """As ``first_error``. Answers as they should be pass a flat shape by one look at their schema, and only others are taken apart.

    Taken apart inside a lambda, so that the code that all rows run stays short: the JVM compiles no method beyond 8,000 bytes.
    """
    fits = _fits(value, shape)
    if fits is None:
        return first_error(value, shape)
    return F.when(~fits, F.get(F.transform(F.array(value), lambda x: first_error(x, shape)), 0))


def _step(path: Column | None, name: Column) -> Column:
    return name if path is None else F.concat(path, F.lit("."), name)


def _say(path: Column, message: Column) -> Column:
    return F.concat(path, F.lit(": "), message)
