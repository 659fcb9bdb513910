"""Operators that prepare text corpora for training: one module for each problem."""
