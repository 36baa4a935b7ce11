"""Where state comes from and goes to."""
