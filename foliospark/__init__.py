"""Evidence-linked document analytics expressed as Spark DataFrame operators."""
