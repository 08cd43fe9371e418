"""lumencat.sources"""
