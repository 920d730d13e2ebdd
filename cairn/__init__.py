"""cairn: text, link, vector and image analytics as DataFrame plans."""
