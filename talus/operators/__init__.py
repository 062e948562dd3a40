"""Dataflow operators: upserts, quality checks, orphan references, schema drift, retrieval, evaluation."""
