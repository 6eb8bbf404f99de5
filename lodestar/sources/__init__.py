"""lodestar.sources"""
