"""Part of cartage; see README.md."""
