"""Column functions: texts, messages, hashes and attachment names. No function here needs a shuffle."""
