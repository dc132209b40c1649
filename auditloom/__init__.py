"""auditloom: analytics over source trees, findings, commits and texts, as Spark DataFrames.

sources     readers: file trees (hidden files included), commit logs
functions   column functions: text, paths, numbers
operators   relational operators: lines, rule scans, manifests, metrics, history, flattening
plans       scores, reports and the registered queries with their SQL counterparts
streaming   incremental scans
llm         operators for text and code corpora; nothing outside it imports it
"""
