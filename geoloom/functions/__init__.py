"""Functions on columns: native expressions, and kernel functions behind Arrow batches."""
