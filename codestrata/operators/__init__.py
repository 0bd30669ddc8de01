"""Relational operators that know no table: ownership by prefix, keyed diff and merge, evidence scoring, matching."""
