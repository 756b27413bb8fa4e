"""Sources and sinks of images and results."""
