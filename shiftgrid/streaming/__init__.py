"""Series of acquisitions, in batch and as a stream."""
