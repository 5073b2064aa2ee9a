"""Row lambdas and the fold algebra."""
