"""bitweft: compression-language-model analytics expressed as Spark DataFrame plans."""
