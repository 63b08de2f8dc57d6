"""Column functions: hrefs, media types, civil dates and times, text."""
