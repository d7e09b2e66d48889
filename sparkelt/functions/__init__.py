"""Column functions: masking, redaction, hashing and verdicts."""
