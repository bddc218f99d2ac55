"""Reading log files: listing, byte ranges, and a streaming source that follows growing files."""
