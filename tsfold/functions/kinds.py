"""B2 classify_kind: raw syntax-node type string -> node kind.

The map is applied as one ``map`` literal Column (constant-folded by
Catalyst, evaluated inside whole-stage codegen); unknown strings give
``Unknown``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's raw-type -> kind table -------
# (raw type string, kind), in the reference's order. "}" appears twice there;
# the first mapping (BlockEnd) wins, so the second one is left out.
RAW_TYPE_TO_KIND = [
    ("program", "Program"),
    ("export_statement", "ExportDecl"),
    ("import_statement", "ImportDecl"),
    ("interface_declaration", "Interface"),
    ("class_declaration", "Class"),
    ("function_declaration", "Function"),
    ("variable_declaration", "Variable"),
    ("property_signature", "Property"),
    ("method_definition", "Method"),
    ("formal_parameters", "Parameter"),
    ("type_annotation", "TypeAnnotation"),
    ("comment", "Comment"),
    ("statement_block", "Block"),
    ("}", "BlockEnd"),
    ("identifier", "Identifier"),
    ("property_identifier", "Identifier"),
    ("type_identifier", "TypeIdentifier"),
    ("object_type", "ObjectType"),
    ("array_type", "ArrayType"),
    ("union_type", "UnionType"),
    ("constructor", "Constructor"),
    ("statement", "Statement"),
    ("expression", "Expression"),
    ("call_expression", "Call"),
    ("member_expression", "Member"),
    ("string", "String"),
    ("string_literal", "String"),
    ("number", "Number"),
    ("number_literal", "Number"),
    (";", "Semicolon"),
    (",", "Comma"),
    ("public", "Public"),
    ("private", "Private"),
    ("protected", "Protected"),
    ("return", "Return"),
    ("this", "This"),
    ("=>", "Arrow"),
    ("=", "Equals"),
    ("[", "LeftBracket"),
    ("]", "RightBracket"),
    ("(", "LeftParen"),
    (")", "RightParen"),
    ("{", "LeftBrace"),
    ("|", "Pipe"),
    ("===", "TripleEquals"),
]
# Second spelling of the import node type used by the reference's other
# language table (Q12): both map to ImportDecl.
EXTRA_RAW_TYPES = [("import_declaration", "ImportDecl")]
# --- end fixed values -------------------------------------------------------


def kind_map() -> Column:
    pairs = RAW_TYPE_TO_KIND + EXTRA_RAW_TYPES
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))


def classify_kind(raw_type: Column) -> Column:
    """raw type -> kind; NULL or unmapped -> 'Unknown'."""
    return F.coalesce(kind_map()[raw_type], F.lit("Unknown"))
