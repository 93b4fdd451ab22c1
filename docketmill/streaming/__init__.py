"""The same folds over Structured Streaming, each with a batch twin that says what it must give."""
