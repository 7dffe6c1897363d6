"""Column functions over LaTeX and spoken text, all from built-ins unless they say otherwise."""
