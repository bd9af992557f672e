"""Where observations come from, and how stores are named and configured."""
