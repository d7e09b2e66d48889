"""Row filters from a condition text such as ``qty >= 8 and kind in ['a', 'b']``.

Python's own parser reads the text; only names, literals, comparisons and
``and`` / ``or`` / ``not`` turn into a Column, anything else is refused. The
result is an ordinary Catalyst predicate, so it is pushed into the scan.
"""

import ast
import operator
from functools import reduce

from pyspark.sql import functions as F

from ..errors import ConditionError

COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt,
    ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
}
LITERALS = (str, int, float, bool, type(None))


class _Condition(ast.NodeVisitor):
    def __init__(self, columns):
        self.columns = columns
        self.used = set()

    def generic_visit(self, node):
        raise ConditionError(f"not allowed in a condition: {type(node).__name__}")

    def visit_Name(self, node):
        if self.columns is not None and node.id not in self.columns:
            raise ConditionError(f"unknown column: {node.id}")
        self.used.add(node.id)
        return F.col(f"`{node.id}`")

    def literal(self, node):
        """Python value of a literal; numbers may carry a sign."""
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            value = self.literal(node.operand)
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                return -value if isinstance(node.op, ast.USub) else value
        elif isinstance(node, ast.Constant) and isinstance(node.value, LITERALS):
            return node.value
        raise ConditionError(f"not a literal: {ast.unparse(node)}")

    def visit_Constant(self, node):
        return F.lit(self.literal(node))

    def visit_UnaryOp(self, node):
        if isinstance(node.op, ast.Not):
            return ~self.visit(node.operand)
        return F.lit(self.literal(node))

    def visit_BoolOp(self, node):
        combine = operator.and_ if isinstance(node.op, ast.And) else operator.or_
        return reduce(combine, map(self.visit, node.values))

    def visit_Compare(self, node):
        # a < b < c means (a < b) and (b < c)
        terms = [node.left, *node.comparators]
        links = zip(terms, node.ops, terms[1:])
        return reduce(operator.and_, [self.link(*link) for link in links])

    def link(self, left, op, right):
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(right, (ast.List, ast.Tuple)):
                raise ConditionError("the right side of 'in' must be a list of literals")
            member = self.visit(left).isin([self.literal(e) for e in right.elts])
            return ~member if isinstance(op, ast.NotIn) else member
        if type(op) not in COMPARE:
            raise ConditionError(f"comparison not allowed: {type(op).__name__}")
        if isinstance(op, (ast.Eq, ast.NotEq)):
            for side, other in ((left, right), (right, left)):
                if isinstance(side, ast.Constant) and side.value is None:
                    tested = self.visit(other)
                    return tested.isNull() if isinstance(op, ast.Eq) else tested.isNotNull()
        return COMPARE[type(op)](self.visit(left), self.visit(right))


def _compile(text, columns):
    text = (text or "").strip()
    if not text:
        raise ConditionError("the condition is empty")
    try:
        body = ast.parse(text, mode="eval").body
    except SyntaxError as error:
        raise ConditionError(f"bad syntax: {error.msg}") from error
    visitor = _Condition(columns)
    return visitor.visit(body), visitor.used


def condition_column(text, columns=None):
    """The condition as a Column; with ``columns`` given, unknown names are refused."""
    return _compile(text, columns)[0]


def condition_columns(text, columns=None):
    """Names of the columns a condition reads."""
    return _compile(text, columns)[1]


def safe_filter(df, text):
    """Rows for which the condition is true; null counts as not true."""
    return df.filter(condition_column(text, df.columns))
