"""Bundled grammars, one text each; parts in <<>> belong to the extended dialect (TypeScript over JavaScript)."""
