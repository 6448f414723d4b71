"""quillspan: lesson-data operators written as plain Spark DataFrame and SQL transformations."""
