"""Composed research plans and the registered queries."""
