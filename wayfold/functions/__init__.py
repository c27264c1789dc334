"""Column functions: geometry of poses, boxes and grids, and text of prompts."""
