"""Writing graphs and transcripts."""
