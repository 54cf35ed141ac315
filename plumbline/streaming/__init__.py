"""Structured Streaming twins of the stateful operators.

Each job is a ``foreachBatch`` over the batch operator. State lives in batch-numbered folders of a shared
store: batch N reads the folders below N and overwrites folder N, so a replay after a failure repeats
itself exactly.
"""
