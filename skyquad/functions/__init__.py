"""Scalar functions, all as Column expressions that stay in whole-stage code generation."""
