"""The row-wise chart extractor on a stream."""
