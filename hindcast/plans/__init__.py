"""The layered table models (staging -> intermediate -> marts) as DataFrame functions."""
