"""Quoting for Spark SQL text."""


def quoted(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\0", "\\0") + "'"


def name(s: str) -> str:
    return "`" + s.replace("`", "``") + "`"


def let(value: str, var: str, body: str) -> str:
    """body with var standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def fail(message: str, kind: str) -> str:
    return f"CAST(raise_error({quoted(message)}) AS {kind})"
