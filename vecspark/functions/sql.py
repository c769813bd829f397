"""The column functions under SQL names, as SQL functions whose bodies are made from the columns themselves.

Spark inlines such a body, so a function in SQL is the same expression as the
column function it was made from.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession, functions as F

from vecspark.functions import bits, casts, dense, half, sparse, text
from vecspark.types import BIT_SQL, SPARSE_SQL, VECTOR_SQL

_INFIX = {"+", "-", "*", "/", "%", "=", "<", ">", "<=", ">=", "<=>", "&", "|", "^", "and", "or"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _literal(value, sql_type: str | None) -> str:
    if value is None:
        return f"CAST(NULL AS {sql_type})" if sql_type else "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        body = f"double('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}')" if not math.isfinite(value) else f"{value!r}D"
        return f"CAST({body} AS {sql_type})" if sql_type and sql_type != "DOUBLE" else body
    if isinstance(value, int):
        return f"CAST({value} AS {sql_type})" if sql_type and sql_type != "INT" else str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_text(column: Column) -> str:
    """A column made of names, literals, functions, lambdas, casts and cases as SQL text."""
    return _text(column._jc.node())


def _text(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name, args = node.functionName(), [_text(a) for a in _items(node.arguments())]
        if name in _INFIX and len(args) == 2:
            return f"({args[0]} {name} {args[1]})"
        if name in ("negative", "-", "not", "!", "~") and len(args) == 1:
            return f"({ {'negative': '-', '!': 'NOT ', 'not': 'NOT '}.get(name, name)}{args[0]})"
        if name == "struct":
            return f"struct({', '.join(args)})"
        return f"{name}({', '.join(args)})"
    if kind in ("UnresolvedAttribute", "UnresolvedNamedLambdaVariable"):
        return node.sql()
    if kind == "Literal":
        dtype = node.dataType()
        return _literal(node.value(), dtype.get().sql() if dtype.isDefined() else None)
    if kind == "LambdaFunction":
        names = [_text(a) for a in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_text(node.function())}"
    if kind == "Cast":
        return f"CAST({_text(node.child())} AS {node.dataType().sql()})"
    if kind == "Alias":
        return f"{_text(node.child())} AS {node.name().apply(0)}"
    if kind == "CaseWhenOtherwise":
        cases = " ".join(f"WHEN {_text(b._1())} THEN {_text(b._2())}" for b in _items(node.branches()))
        other = node.otherwise()
        return f"(CASE {cases} {f'ELSE {_text(other.get())} ' if other.isDefined() else ''}END)"
    if kind == "UnresolvedExtractValue":
        return f"{_text(node.child())}[{_text(node.extraction())}]"
    raise ValueError(f"no SQL text for {kind}")


_TYPES = {"v": VECTOR_SQL, "s": SPARSE_SQL, "b": BIT_SQL, "t": "string", "i": "int", "d": "array<double>"}
#: SQL name -> (argument kinds, column function); one letter of ``_TYPES`` per argument.
FUNCTIONS = {
    **{f"vec_{name}": ("vv", getattr(dense, name)) for name in (
        "l2_distance", "l2_squared_distance", "inner_product", "negative_inner_product", "cosine_distance", "l1_distance", "spherical_distance")},
    "vec_dims": ("v", dense.vector_dims), "vec_norm": ("v", dense.vector_norm), "vec_l2_normalize": ("v", dense.l2_normalize),
    "vec_add": ("vv", dense.vector_add), "vec_sub": ("vv", dense.vector_sub), "vec_mul": ("vv", dense.vector_mul),
    "vec_concat": ("vv", dense.vector_concat), "vec_subvector": ("vii", dense.subvector), "vec_cmp": ("vv", dense.vector_cmp),
    "vec_binary_quantize": ("v", bits.binary_quantize), "vec_from_array": ("d", casts.to_vector), "vec_to_sparse": ("v", sparse.dense_to_sparse),
    "vec_to_half": ("v", half.to_half),
    **{f"half_{name}": ("vv", getattr(half, name)) for name in (
        "l2_distance", "l2_squared_distance", "inner_product", "negative_inner_product", "cosine_distance", "l1_distance", "spherical_distance")},
    "half_l2_normalize": ("v", half.l2_normalize), "half_add": ("vv", half.halfvec_add), "half_sub": ("vv", half.halfvec_sub),
    "half_mul": ("vv", half.halfvec_mul), "half_concat": ("vv", half.halfvec_concat), "half_subvector": ("vii", half.subvector),
    "half_from_array": ("d", casts.to_halfvec),
    **{f"sparse_{name}": ("ss", getattr(sparse, name)) for name in (
        "l2_distance", "l2_squared_distance", "inner_product", "negative_inner_product", "cosine_distance", "l1_distance")},
    "sparse_norm": ("s", sparse.l2_norm), "sparse_l2_normalize": ("s", sparse.l2_normalize), "sparse_cmp": ("ss", sparse.sparsevec_cmp),
    "sparse_to_vec": ("s", casts.sparse_to_vector), "sparse_to_half": ("s", casts.sparse_to_halfvec), "sparse_from_array": ("d", casts.to_sparsevec),
    "bit_hamming_distance": ("bb", bits.hamming_distance), "bit_jaccard_distance": ("bb", bits.jaccard_distance),
    "bit_from_text": ("t", bits.bits_from_text), "bit_to_text": ("b", bits.bits_to_text),
    "vec_to_text": ("v", text.format_vector), "half_to_text": ("v", text.format_halfvec), "sparse_to_text": ("s", text.format_sparsevec),
}


_definitions: dict[str, str] = {}


def definition(name: str) -> str:
    """The arguments and the body of a function; made once."""
    if name not in _definitions:
        kinds, function = FUNCTIONS[name]
        names = "abc"[:len(kinds)]
        args = ", ".join(f"{n} {_TYPES[kind]}" for n, kind in zip(names, kinds))
        _definitions[name] = f"({args}) RETURN {sql_text(function(*map(F.col, names)))}"
    return _definitions[name]


def register_sql_functions(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Define the functions (all, or those of ``names``) for this session; Spark inlines their bodies."""
    names = list(FUNCTIONS) if names is None else names
    for name in names:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition(name)}")
    return names
