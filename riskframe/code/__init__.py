"""Rust source text to functions and their measures: a lexer, a parser that keeps what the measures need, and the measures. No Spark here."""
