"""Column-valued building blocks: text, transforms, dates, urls, coercion."""
